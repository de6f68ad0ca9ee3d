from pyspark.sql import functions as F

from repolith.streaming import events as ev


def feed(spark, folder, batches, schema):
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(folder)


def drained(df, name, mode, tmp_path):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/c-{name}").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name).collect()


def test_debounce_keeps_the_last(spark, tmp_path):
    schema = "path string, type string, at long"
    feed(spark, f"{tmp_path}/in", [[("a", "add", 1), ("a", "change", 3), ("b", "add", 2)], [("a", "unlink", 9)]], schema)
    seen = []
    ev.debounced(ev.stream(spark, f"{tmp_path}/in", schema), lambda d, i: seen.extend(map(tuple, d.collect())), f"{tmp_path}/c", None).awaitTermination()
    assert set(seen) == {("a", "unlink", 9), ("b", "add", 2)}


def test_windows_sessions_limits(spark, tmp_path):
    schema = "user string, s long, v double"
    feed(spark, f"{tmp_path}/in", [[("u", 0, 1.0), ("u", 20, 2.0), ("u", 200, None), ("w", 5, 4.0)]], schema)
    s = ev.stream(spark, f"{tmp_path}/in", schema).withColumn("at", F.timestamp_seconds("s"))
    got = {(r.user, r.n) for r in drained(ev.windowed(s, "at", ["user"], "1 minute"), "w1", "update", tmp_path)}
    assert got == {("u", 2), ("u", 1), ("w", 1)}
    assert len(drained(ev.windowed(s, "at", ["user"], "1 minute", "30 seconds"), "w2", "update", tmp_path)) == 6
    assert sorted((r.user, r.n) for r in drained(ev.sessions(s, "at", "user", "1 minute"), "w3", "complete", tmp_path)) == [("u", 1), ("u", 2), ("w", 1)]
    assert [(r.user, r.n) for r in drained(ev.over_limit(s, "at", "user", 1), "w4", "update", tmp_path)] == [("u", 2)]
    assert {(r.key, r.n, r.total) for r in drained(ev.running_totals(s, "user", "v"), "w5", "update", tmp_path)} == {("u", 3, 3.0), ("w", 1, 4.0)}


def test_upkeep(spark, tmp_path):
    schema = "path string, hash string, at long"
    feed(spark, f"{tmp_path}/in", [[("a", "1", 1), ("a", "2", 5), ("b", None, 2)]], schema)
    state = {"d": spark.createDataFrame([("b", "0"), ("c", "0")], "path string, hash string")}

    def save(d, i):
        state["d"] = spark.createDataFrame([tuple(r) for r in d.collect()], "path string, hash string")

    ev.upkeep(ev.stream(spark, f"{tmp_path}/in", schema), lambda: state["d"], save, f"{tmp_path}/c").awaitTermination()
    assert sorted(map(tuple, state["d"].collect())) == [("a", "2"), ("c", "0")]
