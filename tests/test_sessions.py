import random

import pandas as pd
import pytest

from conftest import rows
from darkslide.operators.sequence import dense_index, gap_ids, running_sums
from darkslide.operators.sessions import KeyedTimers, sessionize

MIN = 60_000_000


def brute(events, gap):
    out, last = [], {}
    for key, at in sorted((k, a) for k, a in events if k is not None and a is not None):
        s = last.get(key)
        if s and at - s[2] <= gap:
            s[2], s[3] = at, s[3] + 1
        else:
            last[key] = [key, at, at, 1]
            out.append(last[key])
    return sorted(map(tuple, out), key=repr)


def run(spark, events, gap=10 * MIN, **k):
    return rows(sessionize(spark.createDataFrame(events, "camera string, at bigint"), "camera", "at", gap, **k))


def test_gap_of_exactly_the_limit_stays(spark):
    base = 1_704_110_400_000_000
    events = [("a", base), ("a", base + 10 * MIN), ("a", base + 20 * MIN + 1), ("b", base + 5 * MIN)]
    assert run(spark, events) == [("a", base, base + 10 * MIN, 2), ("a", base + 20 * MIN + 1, base + 20 * MIN + 1, 1), ("b", base + 5 * MIN, base + 5 * MIN, 1)]


def test_nulls_ties_and_empty_tables(spark):
    assert run(spark, [(None, 1), ("a", None), ("a", 5), ("a", 5)]) == [("a", 5, 5, 2)]
    assert run(spark, []) == []
    with pytest.raises(ValueError):
        run(spark, [("a", 1)], gap=0)


def test_columns_named_like_those_inside_do_no_harm(spark):
    df = spark.createDataFrame([("a", 1, "x", 9, 9), ("a", 2, "y", 9, 9)], "camera string, us bigint, key string, lo int, chunk int")
    assert rows(sessionize(df, "camera", "us", 10)) == [("a", 1, 2, 2)]


@pytest.mark.parametrize("seed", range(3))
def test_like_brute_force_over_chunk_borders_and_before_1970(spark, seed):
    r = random.Random(seed)
    events = [(r.choice("abc"), r.randint(-3000, 3000)) for _ in range(700)] + [("hot", i) for i in range(-500, 500, 2)]
    for gap in (1, 3, 10):
        assert run(spark, events, gap=gap, slots_per_chunk=2) == brute(events, gap)


def test_timers_carry_the_open_session_over_batches():
    t = KeyedTimers(10)
    f = lambda *x: t.update(pd.Series([k for k, _ in x], dtype=object).to_numpy(), *[pd.Series([a for _, a in x]).to_numpy()] * 2, pd.Series([1] * len(x)).to_numpy())
    assert f(("a", 0), ("a", 5)).empty
    assert f(("a", 15), ("a", 26)).values.tolist() == [["a", 0, 15, 3]]
    assert t.close().values.tolist() == [["a", 26, 26, 1]] and t.close().empty


def test_run_numbers(spark):
    # sessions: 0, 5, 36, 40 minutes; the second camera begins anew
    events = [("c1", 0, 1), ("c1", 5 * MIN, 2), ("c1", 36 * MIN, 3), ("c1", 40 * MIN, 4), ("c2", 41 * MIN, 5), ("c2", None, 6)]
    df = spark.createDataFrame(events, "camera string, us bigint, id bigint")
    assert [r.s for r in gap_ids(df, "camera", "us", "id", 30 * MIN, "s").orderBy("id").collect()] == [0, 0, 1, 1, 2]
    # as coded: the next camera's earlier start begins no burst, nor does one close after
    back = spark.createDataFrame([("c1", 90_000_000_000, 1), ("c2", 5, 2), ("c2", 100 * MIN, 3)], "camera string, us bigint, id bigint")
    assert [r.s for r in gap_ids(back, "camera", "us", "id", MIN, "s", split_keys=False).orderBy("id").collect()] == [0, 0, 1]


def test_dense_index_and_running_sums(spark):
    df = spark.range(1000).selectExpr("id", "(id * 37) % 1000 as k", "1 as one").repartition(7)
    assert all(r.k == r.at for r in dense_index(df, [df.k.asc()], "at").collect())
    assert all(r.run_one == r.k + 1 for r in running_sums(df, [df.k.asc()], ["one"]).collect())
