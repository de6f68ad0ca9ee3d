"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.functions.scalars import micros, path_key, repo_key
from repolith.llm import cooccurrence, leaks, mixing, sourcefiles, spans, vectors
from repolith.llm.nearest import nearest_in_time
from repolith.session import cut, table

MINUTE = 60_000_000


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    v = sourcefiles.verdicts(table(spark, d, "files"))
    return v.filter(F.col("verdict").isin("wrong_extension", "corrupt")).select("file_id").distinct()


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of files that do not parse per repository and language."""
    v = sourcefiles.verdicts(table(spark, d, "files"))
    return sourcefiles.bad_rates(v.withColumn("repo", repo_key("repo")))


def p1_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Every file with the languages it parses as."""
    return sourcefiles.verdicts(table(spark, d, "files")).withColumn("repo", repo_key("repo")).distinct()


def _p3(spark: SparkSession, d: str, at_least: float | None = None) -> DataFrame:
    return vectors.similar(vectors.usable(table(spark, d, "semantic_documents"), "id", "vector", 96), at_least=at_least)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = _p3(spark, d, at_least=0.9)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar documents of every usable one."""
    return _p3(spark, d)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return sourcefiles.functions(table(spark, d, "files")).filter("meaningful").select("file_id", "symbol_name", "line").distinct()


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Code and description pairs, trivial ones dropped."""
    return sourcefiles.documented(table(spark, d, "files"), code=True).filter("meaningful").drop("meaningful")


def _p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    pr = table(spark, d, "pull_requests").select(F.col("id").alias("matched_id"), repo_key("repo").alias("entity"), micros("merged_at").alias("t"))
    dep = table(spark, d, "deployments").select(F.col("id").alias("anchor_id"), repo_key("repo").alias("entity"), micros("created_at").alias("t"))
    inc = table(spark, d, "incidents").select(F.col("id").alias("anchor_id"), repo_key("repo").alias("entity"), micros("created_at").alias("t"))
    a = nearest_in_time(dep, pr, 45 * MINUTE).withColumn("pair_kind", F.lit("deployment"))
    b = nearest_in_time(inc, dep.withColumnRenamed("anchor_id", "matched_id"), 120 * MINUTE).withColumn("pair_kind", F.lit("incident"))
    return a.unionByName(b)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _p2_pairs(spark, d).select("anchor_id", "matched_id")


def p2_distance(spark: SparkSession, d: str) -> DataFrame:
    """Pairs and distance by kind."""
    return _p2_pairs(spark, d).groupBy("pair_kind").agg(F.count("*").alias("pairs"), F.sum("distance_us").cast("long").alias("distance_us"), F.max("distance_us").alias("farthest_us"))


def _commits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "commit_changes").select(repo_key("repo").alias("repo"), "sha", path_key("path").alias("path"))


def _p7_report(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The rows of commits; and every pair that changes together by keys, with count, ratio, lift, the count expected, p and q value."""
    rows = _commits(spark, d)
    inc = cut(cooccurrence.incidence(rows, "repo", "sha", "path"))
    out = cooccurrence.surprise(inc, cut(cooccurrence.all_pairs(inc)))
    return rows, out.withColumns({"ratio": F.col("c") / F.col("n_i"), "lift": F.col("c") * F.col("total") / (F.col("n_i") * F.col("n_j"))})


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of ``p7_surprise`` at the thresholds: each has its q value, but count, ratio and lift decide."""
    rows, out = _p7_report(spark, d)
    out = out.filter("q_value is not null and c >= 4 and 2 * c >= n_i and c * total >= 2 * n_i * n_j")
    return cooccurrence.names(rows, out, "repo", "path").select("repo", F.col("a").alias("path_a"), F.col("b").alias("path_b"))


def p7_surprise(spark: SparkSession, d: str) -> DataFrame:
    """All pairs that change together with count, ratio, lift, the count expected, and the p and q value under the configuration null."""
    rows, out = _p7_report(spark, d)
    return cooccurrence.names(rows, out, "repo", "path").select("repo", F.col("a").alias("path_a"), F.col("b").alias("path_b"), "c", "ratio", "lift", "expected", "p_value", "q_value")


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    """All pairs that change together with their exact count, its ratio to the rarer file and the lift."""
    rows = _commits(spark, d)
    out = cooccurrence.all_pairs(cut(cooccurrence.incidence(rows, "repo", "sha", "path")))
    ratio, lift = F.col("c") / F.col("n_i"), F.col("c") * F.col("total") / (F.col("n_i") * F.col("n_j"))
    return cooccurrence.names(rows, out.withColumns({"ratio": F.round(ratio, 9), "lift": F.round(lift, 6)}), "repo", "path").select("repo", F.col("a").alias("path_a"), F.col("b").alias("path_b"), "c", "ratio", "lift")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Per item the number of documents that contain a passage of it."""
    return p8_found(spark, d).groupBy("item_id").agg(F.count("*").alias("docs"))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "source", "text")
    return mixing.mix(mixing.token_counts(docs), table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The drawn documents and how often each is used."""
    return _mixed(spark, d)[0].withColumnRenamed("doc", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source."""
    return _mixed(spark, d)[1]


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.sharing_pairs(_texts(spark, d)).select(F.col("doc_a").alias("doc_id_a"), F.col("doc_b").alias("doc_id_b"))


def p10_class_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different texts that share a span, each text by the smallest document that has it."""
    return spans.sharing_classes(_texts(spark, d))[0].select(F.col("ra").alias("class_a"), F.col("rb").alias("class_b"))


def p10_links(spark: SparkSession, d: str) -> DataFrame:
    """Per document its class of equal texts and the number of documents it shares a span with."""
    return spans.link_counts(_texts(spark, d)).select(F.col("doc").alias("doc_id"), F.col("rep").alias("class_id"), "links")


def p10_shared(spark: SparkSession, d: str) -> DataFrame:
    """Per document how many of its characters lie in spans that another one has too."""
    return spans.shared_characters(_texts(spark, d)).withColumnRenamed("doc", "doc_id")


P2_SQL = """
with pr as (select distinct id, regexp_replace(regexp_replace(lower(repo),'\\s+','','g'),'\\.git$','') r, epoch_us(merged_at) t from pull_requests where merged_at is not null),
dp as (select distinct id, regexp_replace(regexp_replace(lower(repo),'\\s+','','g'),'\\.git$','') r, epoch_us(created_at) t from deployments where created_at is not null),
ic as (select distinct id, regexp_replace(regexp_replace(lower(repo),'\\s+','','g'),'\\.git$','') r, epoch_us(created_at) t from incidents where created_at is not null),
c as (select 'deployment' k, a.id anchor_id, b.id matched_id, abs(a.t-b.t) d from dp a join pr b on a.r=b.r and b.t between a.t-2700000000 and a.t+2700000000
      union all select 'incident', a.id, b.id, abs(a.t-b.t) from ic a join dp b on a.r=b.r and b.t between a.t-7200000000 and a.t+7200000000),
f as (select * from (select *, row_number() over (partition by k, anchor_id order by d, matched_id) n from c) where n=1)
"""
P7_SQL = """
with e as (select distinct regexp_replace(regexp_replace(lower(repo),'\\s+','','g'),'\\.git$','') repo, sha,
           regexp_replace(regexp_replace(replace(path,'\\','/'),'/+','/','g'),'^(\\./)+','') path from commit_changes where sha is not null and repo is not null and path is not null),
n as (select repo, path, count(*) n from e group by all), t as (select repo, count(distinct sha) t from e group by all),
p as (select a.repo, a.path pa, b.path pb, count(*) c from e a join e b on a.repo=b.repo and a.sha=b.sha and a.path<b.path group by all)
select p.repo, pa path_a, pb path_b from p join n x on x.repo=p.repo and x.path=pa join n y on y.repo=p.repo and y.path=pb join t on t.repo=p.repo
where c>=4 and c>=0.5*least(x.n,y.n) and c*t>=2*x.n*y.n
"""
P8_SQL = """
with w(k) as (select unnest(range(0, (select max(length(text)) from (select text from documents union all select text from eval_items)))) ),
i as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text,'')), '[^\\p{L}\\p{N}]+'), lambda x: x<>'') w from eval_items),
iw as (select distinct item_id, array_to_string(w[k+1:k+12],' ') s from i join w on k+12<=len(w)),
d as (select doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(coalesce(text,'')), '[^\\p{L}\\p{N}]+'), lambda x: x<>''),' ') || ' ' w from documents),
dw as (select doc_id, string_split(trim(w),' ') w from d),
dg as (select doc_id, array_to_string(w[k+1:k+12],' ') s from dw join w on k+12<=len(w)),
f as (select distinct doc_id, item_id from dg join iw using (s))
"""
P10_SQL = """
with w as (select doc_id, k, md5(substr(text, k+1, 400)) h from (select doc_id, text, unnest(range(0, length(text)-399)) k from documents where length(text) >= 400))
"""
P10_CLASSES = """
, s as (select doc_id, min(doc_id) over (partition by text) class_id from documents where length(text) >= 400),
p as (select distinct a.doc_id x, b.doc_id y from w a join w b on a.h = b.h and a.doc_id <> b.doc_id)
"""
P10_SHARED = """
, m as (select h from w group by h having count(distinct doc_id) > 1),
s as (select doc_id, least(400, coalesce(lead(k) over (partition by doc_id order by k) - k, 400)) g from w where h in (select h from m)),
t as (select doc_id, sum(g) g from s group by 1)
select doc_id, coalesce(length(text), 0)::bigint n_chars, coalesce(g, 0)::bigint shared_chars from documents left join t using (doc_id)
"""
QUERIES = {"p1_found": p1_found, "p1_rates": p1_rates, "p1_verdicts": p1_verdicts, "p3_found": p3_found, "p3_neighbours": p3_neighbours, "p4_found": p4_found, "p4_pairs": p4_pairs, "p2_found": p2_found, "p2_distance": p2_distance, "p7_found": p7_found, "p7_surprise": p7_surprise, "p7_counts": p7_counts, "p8_found": p8_found, "p8_items": p8_items, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_shared": p10_shared, "p10_class_pairs": p10_class_pairs, "p10_links": p10_links}
SQL = {
    "p2_found": P2_SQL + "select anchor_id, matched_id from f",
    "p2_distance": P2_SQL + "select k pair_kind, count(*) pairs, sum(d)::bigint distance_us, max(d) farthest_us from f group by 1",
    "p7_found": P7_SQL,
    "p7_counts": P7_SQL.partition("select p.repo, pa path_a")[0] + "select p.repo, pa path_a, pb path_b, c, round(c/least(x.n,y.n),9) ratio, round(c*t/(x.n*y.n),6) lift from p join n x on x.repo=p.repo and x.path=pa join n y on y.repo=p.repo and y.path=pb join t on t.repo=p.repo",
    "p8_found": P8_SQL + "select * from f",
    "p10_found": P10_SQL + "select distinct a.doc_id doc_id_a, b.doc_id doc_id_b from w a join w b on a.h = b.h and a.doc_id < b.doc_id",
    "p10_shared": P10_SQL + P10_SHARED,
    "p10_class_pairs": P10_SQL + P10_CLASSES + "select distinct a.class_id class_a, b.class_id class_b from p join s a on a.doc_id = x join s b on b.doc_id = y where a.class_id < b.class_id",
    "p10_links": P10_SQL + P10_CLASSES + "select s.doc_id, s.class_id, count(y) links from s left join p on p.x = s.doc_id group by 1, 2",
    "p8_items": P8_SQL + "select item_id, count(*) docs from f group by 1",
}
