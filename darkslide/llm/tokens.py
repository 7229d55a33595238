"""Queries on token ids of documents (p8)."""

from __future__ import annotations

import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from darkslide.llm.transducer import Transducer, read_ranks
from darkslide.operators.shared import spread
from darkslide.sources.tables import table

#: Where the vocabulary lies, on every machine.
VOCABULARY = os.environ.get("DARKSLIDE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    """One transducer for each vocabulary and Python worker."""
    return Transducer(read_ranks(path))


def token_ids(text: Column, path: str = VOCABULARY) -> Column:
    """Ids of each text, whole; an empty array for null and empty texts."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(texts: pd.Series) -> pd.Series:
        t = transducer(path)
        return pd.Series([t.encode(x) for x in texts])

    return encode(text)


def round_trip(text: Column, path: str = VOCABULARY) -> Column:
    """(n_ids, restored): whether decoding the ids gives the text again; a null text counts as empty."""
    kind = StructType([StructField("n_ids", IntegerType()), StructField("restored", BooleanType())])

    @F.pandas_udf(kind)
    def check(texts: pd.Series) -> pd.DataFrame:
        t, rows = transducer(path), []
        for x in texts:
            ids = t.encode(x)
            rows.append((len(ids), t.decode(ids) == (x or "")))
        return pd.DataFrame(rows, columns=["n_ids", "restored"])

    return check(text)


def p8_ids(spark: SparkSession, data: str) -> DataFrame:
    """doc_id and ids of each document."""
    return spread(table(spark, data, "documents").select("doc_id", "text")).select("doc_id", token_ids(F.col("text")).alias("ids"))


def p8_round_trip(spark: SparkSession, data: str) -> DataFrame:
    """doc_id, n_ids and restored: all texts come back from their ids."""
    return spread(table(spark, data, "documents").select("doc_id", "text")).select("doc_id", round_trip(F.col("text")).alias("r")).select("doc_id", "r.n_ids", "r.restored")


QUERIES = {"p8_ids": p8_ids, "p8_round_trip": p8_round_trip}
ORACLE: dict[str, str] = {}
