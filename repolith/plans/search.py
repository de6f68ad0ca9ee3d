"""Search and learning queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith import relations as rel
from repolith.operators import greedy, search

QUESTIONS = ["retry the slow scheduler", "merge conflict in the registry", "payment webhook token"]


def sem_01_tokens(s: SparkSession, d: str) -> DataFrame:
    t = rel.docs(s, d).select("doc_id", search.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("terms"), F.size(F.array_distinct("t")).cast("long").alias("distinct_terms"))


def agg_25_document_frequency(s: SparkSession, d: str) -> DataFrame:
    """In how many documents each token occurs."""
    t = rel.docs(s, d).select(F.explode(F.array_distinct(search.tokens("text"))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("docs"))


def sem_02_vectors(s: SparkSession, d: str) -> DataFrame:
    return search.hashed_vectors(rel.docs(s, d), "doc_id", "text").select("doc_id", "idx", F.round("value", 4).alias("value"))


def sem_03_lexical(s: SparkSession, d: str) -> DataFrame:
    return search.lexical(rel.docs(s, d), "doc_id", "text", QUESTIONS).withColumn("score", F.round("score", 6))


def sem_04_hybrid(s: SparkSession, d: str) -> DataFrame:
    return search.hybrid(rel.docs(s, d), "doc_id", "text", QUESTIONS).withColumn("score", F.round("score", 9))


def sem_05_cosine(s: SparkSession, d: str) -> DataFrame:
    """Cosine of each embedding to its label's first one, clamped at 0."""
    from repolith.session import table

    e = table(s, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    first = e.groupBy("label").agg(F.min_by("v", "vec_id").alias("w"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s_, x: s_ + x)
    c = F.try_divide(dot("v", "w"), F.sqrt(dot("v", "v")) * F.sqrt(dot("w", "w")))
    return e.join(first, "label").select("vec_id", F.round(F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0))), 4).alias("similarity"))


def sem_06_federated(s: SparkSession, d: str) -> DataFrame:
    """Documents and symbols for one question, fused by rank."""
    q = QUESTIONS[:1]
    a = search.lexical(rel.docs(s, d).select(F.concat(F.lit("doc:"), "doc_id").alias("id"), "text"), "id", "text", q)
    b = search.lexical(rel.symbols(s, d).select(F.concat_ws(":", F.lit("symbol"), "file_id", "name", "line").alias("id"), "name"), "id", "name", q)
    return search.fused([a, b], "id", 20, 50)


def sem_07_excerpts(s: SparkSession, d: str) -> DataFrame:
    return rel.docs(s, d).select("doc_id", F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 320).alias("excerpt"))


def tst_03_budget(s: SparkSession, d: str) -> DataFrame:
    """Per repository the test files that fit into 400 lines, the longest first."""
    t = rel.sources(s, d).filter(F.col("path").rlike(r"_test\.")).select("repo", "path", "lines")
    return greedy.within_budget(t, "repo", "path", "lines", "lines", 400)


def tmp_04_clusters(s: SparkSession, d: str) -> DataFrame:
    """Stars of files that change together."""
    from repolith.plans import reports

    p = reports.QUERIES["jn_17_co_change"](s, d).filter("shared >= 4")
    return greedy.star_clusters(p, "repo", "path_a", "path_b", "shared")


QUERIES = {k: v for k, v in list(globals().items()) if k[:4] in ("agg_", "sem_", "lrn_", "cog_", "tst_", "tmp_") and callable(v)}

_STOP = ",".join(f"'{w}'" for w in search.STOPWORDS)
_TOK = f"t as (select doc_id, list_filter(regexp_split_to_array(lower(regexp_replace(coalesce(text,''),'([a-z0-9])([A-Z])','\\1 \\2','g')),'[^a-z0-9]+'), lambda x: len(x)>=2 and x not in ({_STOP})) w from {{docs}})"
_HASH = "list_reduce(list_prepend(0::bigint, list_transform(string_split(token,''), lambda c: ascii(c)::bigint)), lambda a, b: (((a*31+b+2147483648) % 4294967296) + 4294967296) % 4294967296 - 2147483648)"


_BUDGET = (
    "with recursive o as (select repo, path, lines, row_number() over (partition by repo order by lines desc, path) k from {sources} where regexp_matches(path, '_test\\.') and lines <= 400), "
    "g(repo, k, path, room, took) as (select distinct repo, 0::bigint, '', 400::bigint, false from o union all select o.repo, o.k, o.path, case when o.lines <= g.room then g.room - o.lines else g.room end, o.lines <= g.room from g join o on o.repo = g.repo and o.k = g.k + 1) "
    "select repo, path, row_number() over (partition by repo order by k) place from g where took"
)


def _lex() -> str:
    parts = []
    for q in QUESTIONS:
        terms = search.tokens_of(q)
        hits = "+".join(f"(case when contains(hay,'{t}') then 1 else 0 end)" for t in terms)
        parts.append(f"select '{q}' query, doc_id, round(case when contains(hay,'{' '.join(terms)}') then 0.25::double else 0 end + ({hits})/{len(terms)}::double, 6) score from h")
    return f"with {_TOK}, h as (select doc_id, array_to_string(w,' ') hay from t) select * from (" + " union all ".join(parts) + ") where score > 0"


def _hybrid() -> str:
    """The lexical and the hashed ranking of each question, fused by reciprocal ranks."""
    terms = ",".join(f"('{q}',{i},{x!r}::double)" for q in QUESTIONS for i, x in search.query_vector(q).items())
    lex = _lex().partition(" select * from (")
    vec = SQL_VECTORS.replace("with " + _TOK + ", ", "").replace("select doc_id, idx, round(v,4) as value from z where v <> 0", "")
    return (
        f"{lex[0]}, {vec}, q(query, idx, x) as (values {terms}), l as (select * from ({lex[2]}), m as (select query, doc_id, sum(v*q.x) score from z join q using (idx) group by 1, 2 having sum(v*q.x) > 0), "
        "r as (select query, doc_id, row_number() over (partition by query order by round(score,9) desc, doc_id) r from l union all select query, doc_id, row_number() over (partition by query order by round(score,9) desc, doc_id) from m), "
        f"u as (select query, doc_id, sum(1.0::double/(r+{search.RRF})) score from r where r <= 40 group by 1, 2) select query, doc_id, round(score, 9) score, rank from (select *, row_number() over (partition by query order by round(score,9) desc, doc_id) rank from u) where rank <= 10"
    )


SQL_VECTORS = (
    f"with {_TOK}, x as (select doc_id, unnest(w) token from t), c as (select doc_id, token, count(*) n from x group by 1,2), f as (select token, count(*) df from c group by 1), "
    f"k as (select token, df, {_HASH} h from f), v as (select doc_id, abs(h)%96 idx, sum((ln(n)+1)*(ln(((select count(*) from {{docs}})+1)/(df+1))+1)*(case when h%2=0 then 1 else -1 end)) v from c join k using (token) group by 1,2), "
    "z as (select doc_id, idx, v/sqrt(sum(v*v) over (partition by doc_id)) v from v) select doc_id, idx, round(v,4) as value from z where v <> 0"
)
SQL = {
    k: rel.oracle(v)
    for k, v in {
        "sem_01_tokens": f"with {_TOK} select doc_id, len(w) terms, len(list_distinct(w)) distinct_terms from t",
        "agg_25_document_frequency": f"with {_TOK} select token, count(*) docs from (select unnest(list_distinct(w)) token from t) x group by 1",
        "sem_02_vectors": SQL_VECTORS,
        "sem_04_hybrid": _hybrid(),
        "tst_03_budget": _BUDGET,
        "sem_03_lexical": _lex(),
        "sem_05_cosine": "select vec_id, round(greatest(0.0, coalesce(list_cosine_similarity(e.embedding::double[], f.w::double[]),0)),4) similarity from embeddings e join (select label, min_by(embedding, vec_id) w from embeddings group by 1) f using (label)",
        "sem_07_excerpts": "select doc_id, substr(trim(regexp_replace(text,'\\s+',' ','g')),1,320) excerpt from {docs}",
    }.items()
}
SQL["sem_05_cosine"] = "select vec_id, round(greatest(0.0, coalesce(list_cosine_similarity(e.embedding::double[], f.w::double[]),0)),4) similarity from embeddings e join (select label, min_by(embedding, vec_id) w from embeddings group by 1) f using (label)"
