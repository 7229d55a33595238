"""Evaluation passages in documents (p9)."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkslide.llm.edit_search import EditSearch
from darkslide.llm.ties import union_all
from darkslide.operators.shared import Written, spread
from darkslide.sources.tables import table

#: Characters of passages that one index holds; more passages are searched block by block.
BLOCK_CHARS = 2_000_000
#: Words of a window, allowed word edits, and the recall of windows with that many.
FOUND = {"size": 10, "edits": 2, "recall": 0.9}
NEAR = {"size": 12, "edits": 2, "recall": 0.98}

_loaded: dict[str, EditSearch] = {}


def _index(key: str, data: bytes) -> EditSearch:
    """The index of a block, made ready once in each Python worker."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = pickle.loads(data)
    return _loaded[key]


def near_windows(documents: DataFrame, passages: DataFrame, **search) -> DataFrame:
    """(doc_id, eval_id, edits) of documents (doc_id, text) and passages (eval_id, passage) with windows few word edits apart, and the fewest edits.

    ``search``: the parameters of ``EditSearch``. Null, empty and short texts and
    passages match nothing. The passages are the query set: they are cut into blocks of
    bounded size, an executor makes the index of a block, and it is broadcast. Documents
    are read once for each block and need no shuffle before the matches. With several
    blocks the result reads tables in the shared folder.
    """
    spark = documents.sparkSession
    given = passages.select("eval_id", "passage").dropna()
    size = F.coalesce(F.sum(F.length("passage").cast("bigint")), F.lit(0))
    blocks = max(1, -(-given.agg(size).first()[0] // BLOCK_CHARS))
    texts, found = spread(documents.select("doc_id", "text").filter("doc_id is not null and text is not null")), []
    block = F.pmod(F.xxhash64("eval_id"), F.lit(blocks)).cast("int").alias("block")

    def build(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["eval_id", "passage"])
        return pd.DataFrame({"block": f["block"].iloc[:1], "index": [pickle.dumps(EditSearch(list(zip(f["eval_id"], f["passage"])), **search), protocol=5)]})

    built = given.select(block, "eval_id", "passage").groupBy("block").applyInPandas(build, "block int, index binary")
    if blocks > 1:
        built = Written(built, "passages").df
    for row in built.toLocalIterator():
        held, key = spark.sparkContext.broadcast(row["index"]), uuid.uuid4().hex

        def run(batches: Iterator[pd.DataFrame], held=held, key=key) -> Iterator[pd.DataFrame]:
            index = _index(key, held.value)
            for batch in batches:
                text, passage, edits = index.find(batch["text"].tolist())
                yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[text], "eval_id": passage, "edits": edits.astype("int32")})

        matches = texts.mapInPandas(run, "doc_id bigint, eval_id bigint, edits int")
        if blocks > 1:  # one block's index at a time
            matches = Written(matches, "matches").df
            held.destroy()
        found.append(matches)
    if not found:
        return spark.createDataFrame([], "doc_id bigint, eval_id bigint, edits int")
    return union_all(found).groupBy("doc_id", "eval_id").agg(F.min("edits").alias("edits"))


def p9_found(spark: SparkSession, data: str) -> DataFrame:
    """Documents with ten consecutive words of a passage: doc_id, eval_id.

    Of the windows of ten words that the search verifies as near, those with no edit:
    windows without an edit meet in every table.
    """
    near = near_windows(table(spark, data, "documents"), table(spark, data, "eval_items"), **FOUND)
    return near.filter("edits = 0").select("doc_id", "eval_id")


def p9_near(spark: SparkSession, data: str) -> DataFrame:
    """Documents with a window of twelve words within two word edits of a passage's, and the fewest edits: doc_id, eval_id, edits."""
    return near_windows(table(spark, data, "documents"), table(spark, data, "eval_items"), **NEAR)


QUERIES = {"p9_found": p9_found, "p9_near": p9_near}
ORACLE: dict[str, str] = {}
