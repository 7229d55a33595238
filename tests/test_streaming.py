from datetime import datetime, timedelta

from conftest import rows
from pyspark.sql import functions as F

from darkslide.operators.labels import label_states
from darkslide.operators.sessions import sessionize
from darkslide.streaming.labels import SingleFlight, coalesced, debounced, picture_stream, score_stream, scored_so_far, stream_label_states
from darkslide.streaming.sessions import stream_sessions


def drain(spark, stream, mode, name, path):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_stream_finds_the_sessions_of_the_batch(spark, tmp_path):
    t = datetime(2024, 1, 1, 12)
    minutes = [("a", 0), ("a", 5), ("a", 15), ("a", 26), ("b", 3), ("b", 40), ("end", 600)]
    df = spark.createDataFrame([(k, t + timedelta(minutes=m)) for k, m in minutes], "key string, ts timestamp")
    for i, part in enumerate((df.filter("ts < '2024-01-01 12:10:00'"), df.filter("ts >= '2024-01-01 12:10:00' and key <> 'end'"), df.filter("key = 'end'"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = rows(drain(spark, stream_sessions(stream, "key", "ts", 600_000_000), "append", "sessions", tmp_path / "c"))
    want = rows(sessionize(df.filter("key <> 'end'").withColumn("at", F.unix_micros("ts")), "key", "at", 600_000_000))
    assert [tuple(r) for r in got] == want


def test_stream_joins_what_comes_out_of_order(spark, tmp_path):
    """An event within the watermark joins two sessions that later events had parted, and one before all others opens a session."""
    t = datetime(2024, 1, 1, 12)
    batches = [[("a", 30), ("a", 41)], [("a", 35), ("a", 22), ("b", 36)], [("end", 600)], [("end", 601)]]
    for part in batches:
        spark.createDataFrame([(k, t + timedelta(minutes=m)) for k, m in part], "key string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = drain(spark, stream_sessions(stream, "key", "ts", 600_000_000, "20 minutes"), "append", "disorder", tmp_path / "c").collect()
    got = sorted((r.key, (r.start // 60_000_000 - out[0].start // 60_000_000), r.n) for r in out)
    assert [(k, n) for k, _, n in got] == [("a", 4), ("b", 1)]
    a = next(r for r in out if r.key == "a")
    assert a.end - a.start == 19 * 60_000_000


def test_stream_of_label_changes(spark, tmp_path):
    log = [(1, 1, "keep", "auto"), (1, 2, "trash", "manual"), (1, 3, "keep", "auto"), (2, 4, "trash", "auto"), (2, 5, "", "auto"), (3, 6, "keep", "manual"), (3, 7, "", "manual"), (3, 8, "trash", "auto")]
    df = spark.createDataFrame(log, "path bigint, seq bigint, state string, source string")
    df.filter("seq % 2 = 0").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.filter("seq % 2 = 1").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = drain(spark, stream_label_states(stream), "update", "labels", tmp_path / "c").collect()
    last = {}
    for r in out:
        last[int(r.path)] = r.state
    assert last == {r.path: r.state for r in label_states(df).collect()}


def test_single_flight_runs_one_at_a_time_and_joins_requests():
    now, slept, flight = [0.0], [], None

    def sleep(s):
        slept.append(s)
        now[0] += s

    def run(last):
        if last is None:  # requests during a run become one more run
            assert not flight.request() and not flight.request()
        now[0] += 0.5
        if last == 1:
            raise RuntimeError("lost")
        return (last or 0) + 1

    flight = SingleFlight(run, 1.5, lambda: now[0], sleep)
    assert flight.request() and (flight.runs, flight.failed, flight.result, slept) == (1, 1, 1, [1.0])
    flight.run = lambda last: last + 1
    assert flight.request() and flight.result == 2


def test_scoring_stream_can_be_read_and_goes_on(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1), (2, 0.2)], "id bigint, x double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    go = lambda: score_stream(stream, lambda b: b.select("id", (F.col("x") * 2).alias("p")), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    go()
    spark.createDataFrame([(2, 0.5)], "id bigint, x double").write.mode("append").parquet(str(tmp_path / "in"))
    go()
    assert rows(scored_so_far(spark, str(tmp_path / "out"), "id")) == [(1, 0.2), (2, 1.0)]


def test_pictures_come_in_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(5):
        (tmp_path / "in" / f"{i}.bin").write_bytes(bytes([i]))
    out = drain(spark, picture_stream(spark, str(tmp_path / "in"), 2).select("content"), "append", "pictures", tmp_path / "c")
    assert sorted(bytes(r.content)[0] for r in out.collect()) == [0, 1, 2, 3, 4]


def test_debounced_and_coalesced(spark, tmp_path):
    t = datetime(2024, 1, 1, 12)
    log = [("a", 0.0, "x"), ("a", 0.4, "y"), ("a", 5.0, "z"), ("b", 0.1, "x"), ("end", 99.0, "x")]
    df = spark.createDataFrame([(k, t + timedelta(seconds=s), v) for k, s, v in log], "k string, ts timestamp, v string")
    for i, part in enumerate((df.filter("k <> 'end'"), df.filter("k = 'end'"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = drain(spark, debounced(stream, "k", "ts", "v"), "append", "quiet", tmp_path / "c").collect()
    assert sorted((r.k, r.v, r.n) for r in out) == [("a", "y", 2), ("a", "z", 1), ("b", "x", 1)]
    out = drain(spark, coalesced(stream, "k", "ts"), "append", "first", tmp_path / "d").collect()
    assert sorted(r.k for r in out) == ["a", "b", "end"]
