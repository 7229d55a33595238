"""Same or near-same records across splits: an index of the evaluation records, through which all training records stream (p3).

The 64 bits of a perceptual hash are cut into ten pieces, of which two hashes within
eight bits share at least two. A record becomes five short texts, the pieces in five
orders such that any two pieces stand side by side in exactly one; so every pair
within eight bits has a maximal match of two or more symbols, which single symbols,
shared by chance by one record in a hundred, do not decide. The spans of a pair's
matches are merged to the pieces that it shares, and their count tells how much is
left to compare: nothing if all ten are shared. Item and group are texts of one
symbol. Symbols of different runs are different symbols.

Evaluation records lie in shards: small runs together, a large run in several. The
index of a shard is built once. A training record goes to the shards of its run, for
all but huge runs one; shards that many training records meet are copied to as many
blocks as these fill, in their compressed form.
"""

from __future__ import annotations

import pickle
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from darkslide.llm.fm_index import FMIndex, merged, paths
from darkslide.llm.ties import assigned, union_all
from darkslide.operators.hamming import hash_bits
from darkslide.operators.shared import Written
from darkslide.operators.skew import skew_safe_lookup
from darkslide.sources.tables import table

MAX_BITS = 8
#: Evaluation records of an index, and training records that stream through it in one task.
SHARD, BLOCK = 16_384, 65_536
#: Ten pieces of 64 bits: first bit and width; hashes within MAX_BITS share LEAST of them or more.
PIECES = [(64 * i // 10, 64 * (i + 1) // 10 - 64 * i // 10) for i in range(10)]
LEAST = len(PIECES) - MAX_BITS
ORDERS = paths(len(PIECES))
_ITEM, _GROUP = 1 << len(PIECES), 2 << len(PIECES)


@F.pandas_udf(StringType())
def _name_key(names: pd.Series) -> pd.Series:
    return names.map(name_key, na_action="ignore")


# Else a filter on the key would be moved below it, and all names made twice.
_name_key = _name_key.asNondeterministic()


def name_key(name: str | None) -> str | None:
    """The last path part without outer white space, case and composition; None if nothing is left."""
    if name is None:
        return None
    last = name.strip().replace("\\", "/").rpartition("/")[2].strip()
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", last).lower()) or None


def name_keys(name: str) -> Column:
    """``name_key`` of a column; only names that are not plain ASCII go through Python."""
    c = F.col(name)
    plain, blank = F.octet_length(c) == F.length(c), F.lit(_ASCII_BLANK)
    last = F.btrim(F.substring_index(F.translate(F.btrim(c, blank), "\\", "/"), "/", -1), blank)
    return F.coalesce(F.nullif(F.when(plain, F.lower(last)), F.lit("")), _name_key(F.when(~plain, c)))


#: What strip() takes from ASCII text.
_ASCII_BLANK = "".join(c for c in map(chr, range(128)) if c.isspace())


class Shard:
    """The index of evaluation records (run_id, split_name, item_id, group_id, grouped, bits, hashed); the flags tell whether there are a group and a hash."""

    def __init__(self, f: pd.DataFrame):
        self.runs, run = np.unique(f["run_id"].to_numpy(np.int64), return_inverse=True)
        self.run, self.split, self.item = run, f["split_name"].to_numpy(), f["item_id"].to_numpy(np.int64)
        rows = np.arange(len(f))
        hashed, grouped = rows[f["hashed"].to_numpy()], rows[f["grouped"].to_numpy()]
        self.bits = f["bits"].to_numpy(np.int64).view(np.uint64)
        self.values = [np.unique(run[hashed] * 128 + v) for v in _pieces(self.bits[hashed])]
        codes = np.stack([np.searchsorted(v, run[hashed] * 128 + x) for v, x in zip(self.values, _pieces(self.bits[hashed]))], axis=1)
        self.hashes = [FMIndex(codes[:, o], [len(self.values[p]) for p in o], hashed) for o in ORDERS]
        self.items, self.item_index = self._single(self.item, rows)
        self.groups, self.group_index = self._single(f["group_id"].to_numpy(np.int64)[grouped], grouped)

    def _single(self, value: np.ndarray, rows: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], FMIndex]:
        """Texts of one symbol, a pair of run and value."""
        values, code = np.unique(value, return_inverse=True)
        both, code = np.unique(self.run[rows] * max(1, len(values)) + code, return_inverse=True)
        return (values, both), FMIndex(code[:, None], [len(both)], rows)

    def overlaps(self, f: pd.DataFrame) -> pd.DataFrame:
        """Pairs of the training records ``f`` with the index's that are the same or near-same."""
        run, item = _code(self.runs, f["run_id"].to_numpy(np.int64)), f["item_id"].to_numpy(np.int64)
        hashed, grouped = np.flatnonzero((run >= 0) & f["hashed"].to_numpy()), np.flatnonzero((run >= 0) & f["grouped"].to_numpy())
        bits, found = f["bits"].to_numpy(np.int64).view(np.uint64), []
        codes = np.stack([_code(v, run[hashed] * 128 + x) for v, x in zip(self.values, _pieces(bits[hashed]))], axis=1)
        for order, index in zip(ORDERS, self.hashes):
            q, r, a, b = index.maximal_matches(codes[:, order], LEAST)
            found.append((hashed[q], r, _SPANS[ORDERS.index(order)][a, b]))
        for (values, both), index, rows, value, bit in (
            (self.items, self.item_index, np.flatnonzero(run >= 0), item, _ITEM),
            (self.groups, self.group_index, grouped, f["group_id"].to_numpy(np.int64), _GROUP),
        ):
            code = _code(values, value[rows])
            code = np.where(code >= 0, _code(both, run[rows] * max(1, len(values)) + code), -1)
            q, r, _, _ = index.maximal_matches(code[:, None], 1)
            found.append((rows[q], r, np.full(len(q), bit)))
        q, r, mask = merged(*(np.concatenate(x) for x in zip(*found)), max(1, len(self.item)))
        shared = np.bitwise_count(mask & (_ITEM - 1))
        hit = (mask >= _ITEM) | (shared == len(PIECES))
        open_ = np.flatnonzero(~hit)
        hit[open_] = np.bitwise_count(bits[q[open_]] ^ self.bits[r[open_]]) <= MAX_BITS
        q, r = q[hit], r[hit]
        a, b = item[q], self.item[r]
        return pd.DataFrame({"run_id": self.runs[self.run[r]], "split_name": self.split[r], "item_lo": np.minimum(a, b), "item_hi": np.maximum(a, b)})


def _pieces(bits: np.ndarray) -> list[np.ndarray]:
    return [((bits >> np.uint64(at)) & np.uint64((1 << w) - 1)).astype(np.int64) for at, w in PIECES]


#: Of each order: the pieces, as bits, of the span from one column to another.
_SPANS = [np.array([[sum(1 << p for p in o[a : b + 1]) for b in range(len(o))] for a in range(len(o))], dtype=np.int64) for o in ORDERS]


def _code(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in sorted ``values``, -1 where it is not there."""
    if not len(values):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return np.where(values[at] == wanted, at, -1)


def _build(f: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({**{c: f[c].iloc[:1] for c in ("pack", "sub", "blocks")}, "index": [pickle.dumps(Shard(f), protocol=5)]})


def _search(shard: pd.DataFrame, training: pd.DataFrame) -> pd.DataFrame:
    if not len(shard) or not len(training):
        return pd.DataFrame({"run_id": [], "split_name": [], "item_lo": [], "item_hi": []}).astype({"run_id": "int64", "item_lo": "int64", "item_hi": "int64"})
    return pickle.loads(shard["index"].iloc[0]).overlaps(training)


def cross_split_overlaps(members: DataFrame) -> DataFrame:
    """Distinct (run_id, split_name, item_lo, item_hi) of ``members`` (run_id, split_name, item_id, group_id, phash).

    split_name is train or an evaluation split. group_id and phash may be null and
    then match nothing; phash is 16 hex digits. Repeated members count once, runs
    without a training or an evaluation record give nothing.
    """
    train = F.col("split_name") == "train"
    bits, group = hash_bits("phash"), F.col("group_id")
    m = members.select("run_id", "split_name", "item_id", F.coalesce(group, F.lit(-1)).alias("group_id"), group.isNotNull().alias("grouped"), F.coalesce(bits, F.lit(0)).alias("bits"), bits.isNotNull().alias("hashed"))
    m = Written(m, "members").df
    sizes = m.groupBy("run_id").agg(F.count("*").alias("n"), F.sum(train.cast("bigint")).alias("trained"))
    sizes = Written(sizes.withColumn("subs", F.ceil((F.col("n") - F.col("trained")) / SHARD)).filter("subs > 0 and trained > 0"), "runs").df
    packs = sizes.filter("subs = 1").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.col("n") - F.col("trained")) / SHARD)).alias("packs"))
    # A pack is named by a hash of its number, a run of several shards by its own id.
    pack = F.when(F.col("subs") == 1, F.struct(F.lit(0).alias("kind"), F.pmod(F.xxhash64("run_id"), F.coalesce("packs", F.lit(1))).alias("id")))
    pack = pack.otherwise(F.struct(F.lit(1).alias("kind"), F.col("run_id").alias("id")))
    sizes = sizes.crossJoin(F.broadcast(packs)).select("run_id", "n", "trained", "subs", F.xxhash64(pack).alias("pack"))
    blocks = sizes.groupBy("pack").agg(F.ceil(F.sum("trained") / BLOCK).alias("blocks"))
    sizes = sizes.join(blocks, "pack").select("run_id", "n", "subs", "pack", "blocks")
    m = skew_safe_lookup(m, "run_id", sizes, ["pack", "subs", "blocks"], "n").filter("pack is not null")
    columns = ["run_id", "split_name", "item_id", "group_id", "grouped", "bits", "hashed"]
    part = lambda n: F.pmod(F.xxhash64("item_id", "split_name"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    evaluation = m.filter(~train).select("pack", part("subs").alias("sub"), "blocks", *columns)
    shards = evaluation.groupBy("pack", "sub").applyInPandas(_build, "pack bigint, sub bigint, blocks bigint, index binary")
    shards = shards.select("pack", "sub", every("blocks").alias("block"), "index")
    training = m.filter(train).select("pack", part("blocks").alias("block"), every("subs").alias("sub"), "run_id", "item_id", "group_id", "grouped", "bits", "hashed")
    training = training.select(*[F.col(c).alias(c) for c in training.columns])  # columns of their own, apart from evaluation's
    keys = ["pack", "sub", "block"]
    found = shards.groupBy(*keys).cogroup(training.groupBy(*keys)).applyInPandas(_search, "run_id bigint, split_name string, item_lo bigint, item_hi bigint")
    return found.distinct()


def _members(spark: SparkSession, data: str) -> DataFrame:
    runs = table(spark, data, "benchmark_results").filter("run_id is not null")
    # A union of three explodes: rows of one explode over a list of lists would each carry a whole list.
    lists = [runs.select("run_id", F.lit(s).alias("split_name"), F.explode(f"{s}_filenames").alias("name")) for s in ("train", "test", "val")]
    entries = union_all(lists).filter("name is not null")
    entries = entries.select("run_id", "split_name", name_keys("name").alias("key")).filter("key is not null")
    phash = F.when(F.col("phash").rlike("^[0-9A-Fa-f]{16}$"), F.col("phash"))
    items = table(spark, data, "image_items").filter("item_id is not null and filename is not null")
    items = items.select(name_keys("filename").alias("key"), "item_id", assigned("group_id").alias("group_id"), phash.alias("phash")).distinct()
    return entries.join(items, "key").select("run_id", "split_name", "item_id", "group_id", "phash").distinct()


def p3_found(spark: SparkSession, data: str) -> DataFrame:
    """Pairs of an evaluation item and a training item of one run that are the same or near-same."""
    return cross_split_overlaps(_members(spark, data))


def p3_report(spark: SparkSession, data: str) -> DataFrame:
    """Per run, evaluation split and album: items of the split, and those that training has the same or near-same of."""
    members = _members(spark, data)
    found = cross_split_overlaps(members)
    hit = found.select("run_id", "split_name", F.explode(F.array("item_lo", "item_hi")).alias("item_id")).distinct().withColumn("hit", F.lit(1))
    albums = table(spark, data, "image_items").groupBy("item_id").agg(F.max("album").alias("album"))
    listed = members.filter("split_name <> 'train'").select("run_id", "split_name", "item_id").distinct()
    return (
        listed.join(hit, ["run_id", "split_name", "item_id"], "left").join(albums, "item_id")
        .groupBy("run_id", "split_name", "album").agg(F.count("*").alias("n_items"), F.count("hit").alias("n_overlapping"))
    )


QUERIES = {"p3_found": p3_found, "p3_report": p3_report}

_MEMBERS = """
with l as (select run_id, 'test' as split_name, unnest(test_filenames) as f from benchmark_results
  union all select run_id, 'val', unnest(val_filenames) from benchmark_results
  union all select run_id, 'train', unnest(train_filenames) from benchmark_results),
k as (select distinct run_id, split_name, nfc_normalize(lower(nfc_normalize(trim(regexp_replace(trim(f), '^.*[/\\\\]', ''))))) as name from l),
i as (select distinct item_id, nfc_normalize(lower(nfc_normalize(trim(filename)))) as name, nullif(group_id, -1) as group_id,
  case when regexp_full_match(phash, '[0-9A-Fa-f]{16}') then ('0x' || phash)::ubigint end as h from image_items),
m as (select distinct run_id, split_name, item_id, group_id, h from k join i using (name) where name <> ''),
found as (select distinct e.run_id, e.split_name, least(e.item_id, t.item_id) as item_lo, greatest(e.item_id, t.item_id) as item_hi
  from m e join m t on e.run_id = t.run_id and e.split_name <> 'train' and t.split_name = 'train'
  where e.item_id = t.item_id or e.group_id = t.group_id or bit_count(xor(e.h, t.h)) <= 8)"""

ORACLE = {
    "p3_found": _MEMBERS + " select * from found",
    "p3_report": _MEMBERS + """, hit as (select run_id, split_name, item_lo as item_id from found union select run_id, split_name, item_hi from found),
al as (select item_id, max(album) as album from image_items group by 1), li as (select distinct run_id, split_name, item_id from m where split_name <> 'train')
select run_id, split_name, album, count(*) as n_items, count(hit.item_id) as n_overlapping from li left join hit using (run_id, split_name, item_id) join al using (item_id) group by 1, 2, 3""",
}
