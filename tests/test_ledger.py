import random

from pyspark.sql import functions as F

from repolith.operators import ledger

COLS = "history_id long, issue_key string, issue_created_at timestamp, created_at timestamp, field string, from_string string, to_string string, ingested_at timestamp"


def log(spark, rows):
    d = spark.createDataFrame(rows, "h long, i string, b long, c long, f string, o string, n string, r long")
    t = F.timestamp_micros
    return ledger.change_log(d.select(F.col("h").alias("history_id"), F.col("i").alias("issue_key"), t("b").alias("issue_created_at"), t("c").alias("created_at"), F.col("f").alias("field"), F.col("o").alias("from_string"), F.col("n").alias("to_string"), t("r").alias("ingested_at"), F.lit(1).alias("owner")))


def replay(rows, recorded):
    """What was believed at a recorded time, by going through the changes."""
    out, by = set(), {}
    for h, i, b, c, f, o, n, r in rows:
        if r <= recorded:
            by.setdefault((i, f), []).append((c, h, o, n, b))
    for (i, f), v in by.items():
        v.sort()
        marks = [(v[0][4], v[0][2])] + [(c, n) for c, h, o, n, b in v]
        for (s, x), (e, _) in zip(marks, marks[1:] + [(None, None)]):
            if e is None or s < e:
                out.add((i, f, x, s, e))
    return out


def test_ledger_at_every_recorded_time(spark, sizes):
    rng = random.Random(5)
    rows = []
    for h in range(60):
        c = rng.randrange(10, 400)
        rows.append((h, rng.choice("ab"), 1, c, rng.choice(["status", "owner"]), f"o{h}", f"n{h}", c + rng.choice([1, 2, 5, 90, 200])))
    book = ledger.ledger(log(spark, rows), bucket_us=50).cache()
    for at in (0, 60, 150, 300, 1000):
        got = {(r.entity, r.attr, r.value, r.valid_from, r.valid_to) for r in ledger.as_of(book, at).collect()}
        assert got == replay(rows, at), at
    now = {(r.entity, r.attr, r.value, r.valid_from, r.valid_to) for r in ledger.as_of(book).collect()}
    assert now == replay(rows, 10**9)


def test_nothing_is_overwritten(spark, sizes):
    rows = [(1, "a", 0, 10, "f", "x", "y", 11), (2, "a", 0, 30, "f", "y", "z", 31), (3, "a", 0, 20, "f", "y", "w", 50)]
    book = [(r.value, r.valid_from, r.valid_to, r.recorded_from, r.recorded_to) for r in ledger.ledger(log(spark, rows)).collect()]
    assert ("y", 10, 30, 31, 50) in book and ("y", 10, 20, 50, None) in book and ("w", 20, 30, 50, None) in book


def test_versions_merge_equal_values_and_ties(spark, sizes):
    rows = [(1, "a", 0, 10, " Status", None, "Open ", 10), (1, "a", 0, 10, "status", None, "Open ", 12), (2, "a", 0, 20, "STATUS", "Open", "open", 20), (3, "a", 0, 30, "status", "open", "x", 30), (4, "a", 0, 30, "status", "x", "done", 30), (5, None, 0, 1, "status", "", "", 1), (6, "a", 0, 5, None, "", "", 1)]
    got = sorted((r.value, r.valid_from, r.valid_to) for r in ledger.versions(ledger.ledger(log(spark, rows))).collect() if r.value is not None)
    assert got == [("Open ", 10, 30), ("done", 30, -1)]


def test_empty(spark, sizes):
    assert ledger.versions(ledger.ledger(log(spark, []))).count() == 0
