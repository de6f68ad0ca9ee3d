from repolith.operators import greedy, search


def test_terms_and_hash(spark):
    d = spark.createDataFrame([(1, "validateAuth_token for the HTTP/Server"), (2, None), (3, "")], "id long, text string")
    got = {r.id: r.t for r in d.select("id", search.tokens("text").alias("t")).collect()}
    assert got == {1: ["validate", "auth", "token", "http", "server"], 2: [], 3: []}
    assert got[1] == search.tokens_of("validateAuth_token for the HTTP/Server")
    w = spark.createDataFrame([("authentication",), ("zz",)], "t string")
    assert {r.t: r.h for r in w.select("t", search.rolling_hash(w.t).alias("h")).collect()} == {t: search.hash_of(t) for t in ("authentication", "zz")}


def test_hybrid_finds_the_match(spark):
    d = spark.createDataFrame([(1, "authenticateUser checks the auth token"), (2, "billing retries"), (3, None)], "id long, text string")
    top = search.hybrid(d, "id", "text", ["validate auth token"], 2).orderBy("rank").first()
    assert top.id == 1
    assert search.lexical(d, "id", "text", ["the of"]).count() == 0


def test_budget_and_stars(spark):
    d = spark.createDataFrame([("g", "a", 3.0, 5.0), ("g", "b", 2.0, 9.0), ("g", "c", 1.0, 4.0), ("g", "d", None, 1.0)], "g string, x string, p double, c double")
    assert [r.x for r in greedy.within_budget(d, "g", "x", "p", "c", 10).orderBy("place").collect()] == ["a", "c"]
    p = spark.createDataFrame([("g", "a", "b", 5), ("g", "a", "c", 4), ("g", "b", "c", 9), ("g", "d", "e", 1)], "g string, a string, b string, w long")
    got = {(r.anchor, r.member) for r in greedy.star_clusters(p, "g", "a", "b", "w").collect()}
    assert got == {("a", "b"), ("a", "c"), ("d", "e")}
