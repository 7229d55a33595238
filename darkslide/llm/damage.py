"""Documents decoded with a wrong encoding (p10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkslide.llm.mojibake import CLASSES, Pairs, pairs, repair
from darkslide.operators.shared import spread
from darkslide.sources.tables import table

_KIND = "doc_id bigint, text string, n_stretches int, restored boolean"


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros(CLASSES**2, dtype=np.int64)
    for b in batches:
        counts += np.bincount(pairs("\n".join(b["text"])), minlength=len(counts))
    at = np.flatnonzero(counts)
    yield pd.DataFrame({"pair": at.astype(np.int32), "n": counts[at]})


def pair_counts(documents: DataFrame) -> np.ndarray:
    """Occurrences of each pair of neighbouring characters in all texts; there are CLASSES squared pairs, whatever the corpus."""
    counts = np.zeros(CLASSES**2, dtype=np.int64)
    for r in documents.select("text").mapInPandas(_count, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["pair"]] = r["n"]
    return counts


def damaged(documents: DataFrame) -> DataFrame:
    """doc_id, text, n_stretches and restored of the documents with damage.

    Pure ASCII texts cannot be damaged and never leave the JVM. Null and empty texts
    and null ids give no row, repeated rows one each. Texts are read twice: once for
    the letter pairs of the corpus, once to find and undo damage.
    """
    odd = spread(documents.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & (F.octet_length("text") > F.length("text"))))
    held = documents.sparkSession.sparkContext.broadcast(pair_counts(odd))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Pairs(held.value)
        for b in batches:
            rows = [(d, *repair(t, model)) for d, t in zip(b["doc_id"], b["text"])]
            yield pd.DataFrame([r for r in rows if r[2]], columns=["doc_id", "text", "n_stretches", "restored"]).astype({"doc_id": "int64", "text": object, "n_stretches": "int32", "restored": bool})

    return odd.mapInPandas(run, _KIND)


def p10_found(spark: SparkSession, data: str) -> DataFrame:
    """doc_id of each damaged document."""
    return damaged(table(spark, data, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, data: str) -> DataFrame:
    """Damaged documents with the restored text: doc_id, text, n_stretches, restored."""
    return damaged(table(spark, data, "documents"))


QUERIES = {"p10_found": p10_found, "p10_restored": p10_restored}
ORACLE: dict[str, str] = {}
