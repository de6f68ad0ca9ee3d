from repolith.llm import sourcefiles


def test_go_type_parameters(spark):
    text = "package p\n\n" + "".join(f"// {n} does all that one asks of it.\n{h} {{\n\treturn\n}}\n\n" for n, h in [
        ("Map", "func Map[S ~[]E, E any](s S)"), ("F", "func F[K comparable, M map[K]int](m M)"), ("G", "func G[T interface{ ~int }](t T) []T"), ("Get", "func (t *T[K, V]) Get(k K) V"), ("Old", "func (t (*T)) Old()"), ("P", "func P(a []int)"),
    ])
    rows = sourcefiles.documented(spark.createDataFrame([(1, "a.go", text)], "file_id long, path string, file_text string")).collect()
    assert sorted((r.symbol_name, r.kind, r.line) for r in rows) == sorted([("Map", "function", 4), ("F", "function", 9), ("G", "function", 14), ("Get", "method", 19), ("Old", "method", 24), ("P", "function", 29)])
