"""Picture files: listing, perceptual hashes and feature vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from darkslide.functions.pixels import decode_png, feature_vector, perceptual_hash

# Fixed value: endings of picture files.
EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "gif", "tif", "tiff", "webp")
#: Pictures of one Arrow batch are at most so many; the binary source gives one row a file.
Decoder = Callable[[bytes], "np.ndarray | None"]


def scan(spark: SparkSession, folder: str, max_images: int | None = None, content: bool = True) -> DataFrame:
    """Picture files of a folder (path, filename, modificationTime, length, content), by name; none or all with ``max_images`` of 0 or None."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    f = f.withColumn("filename", F.element_at(F.split("path", "/"), -1)).filter(F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1)).isin(*EXTENSIONS))
    f = f if content else f.drop("content")
    return f.orderBy("filename").limit(max_images) if max_images and max_images > 0 else f


def cache_key(path: Column, modified: Column, size: Column) -> Column:
    """What a result computed from a file is kept under; it changes with the file."""
    return F.sha2(F.concat_ws(":", path, F.unix_micros(modified).cast("string"), size.cast("string")), 256)


def hashes(files: DataFrame, decode: Decoder = decode_png) -> DataFrame:
    """(path, phash) of files (path, content); null for what cannot be decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pictures = [decode(bytes(c)) if c is not None else None for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "phash": [perceptual_hash(p) if p is not None else None for p in pictures]})

    return files.select("path", "content").mapInPandas(run, "path string, phash string")


def vectors(files: DataFrame, class_names: list[str], decode: Decoder = decode_png, full: bool = False) -> DataFrame:
    """(path, features) of files (path, content, length, exif array<double>, classes array<string>); null for what cannot be decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for content, size, exif, classes in b[["content", "length", "exif", "classes"]].itertuples(index=False):
                p = decode(bytes(content)) if content is not None else None
                given = set() if classes is None else set(classes)
                out.append(feature_vector(p, list(exif), given, class_names, int(size), 16 if full else 8) if p is not None else None)
            yield pd.DataFrame({"path": b["path"], "features": out})

    return files.select("path", "content", "length", "exif", "classes").mapInPandas(run, "path string, features array<double>")
