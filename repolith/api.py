"""One entry point over a folder of tables: reports by name, relations as views, read-only SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from repolith import relations


#: Tools by name: the report each runs and the parameters it takes.
TOOLS: dict[str, tuple[str, tuple[str, ...]]] = {
    "scan": ("src_04_file_rows", ("file_id",)), "impact": ("imp_05_changed_symbols", ("repo", "path", "sha")), "context": ("jn_03_file_context", ("file_id",)), "validate": ("inv_01_invariants", ("rule", "repo", "path")), "signals": ("sig_01_signals", ("rule", "severity")),
    "tests": ("tst_02_prioritise", ("repo", "path")), "dependencies": ("gr_01_dependents", ("id",)), "hotpaths": ("hot_01_hot_paths", ("category", "role")), "complexity": ("cpx_05_file_score", ("file_id",)), "refactor_plan": ("ref_01_plan", ()), "memory": ("src_24_memory", ("source",)), "drift": ("drf_01_report", ()),
    "query": ("", ("text", "limit")), "semantic_search": ("", ("text", "limit")), "review_context": ("imp_06_review_context", ("repo", "sha", "path")), "detect_changes": ("src_12_content_changes", ("change", "path")), "sql": ("", ("text",)), "history": ("tmp_06_file_history", ("repo", "path")),
    "co_changes": ("jn_17_ratios", ("repo", "path_a", "path_b")), "volatility": ("tmp_05_volatility", ("repo", "path")), "plan": ("lrn_01_plan", ()), "locate": ("lrn_02_locate", ()), "embed_graph": ("sem_02_vectors", ("doc_id",)), "docs_section": ("src_27_sections", ("doc_id", "slug")), "graph_stats": ("gr_19_stats", ()),
}


class Engine:
    """Reports and relations of a data folder.

    ``report("agg_15_bus_factor")`` runs one of ``reports()``; ``relation("commits")`` gives
    a relation; ``sql(text)`` runs a query over the relations and accepts nothing that writes.
    """

    _READS = re.compile(r"\s*(?:--[^\n]*\n\s*)*(?:select|with|values)\b", re.I)
    _WRITES = re.compile(r"\b(?:insert|update|delete|merge|drop|alter|truncate|create|replace\s+table|load|cache|refresh|set|use)\b", re.I)

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def relations(self) -> list[str]:
        return sorted(n.rstrip("_") for n in relations.BUILD)

    def relation(self, name: str) -> DataFrame:
        return relations.BUILD[name if name in relations.BUILD else name + "_"](self.spark, self.folder)

    def sql(self, text: str) -> DataFrame:
        bare = re.sub(r"'(?:[^']|'')*'", "''", text)
        if not self._READS.match(text) or self._WRITES.search(bare) or ";" in bare.rstrip().rstrip(";"):
            raise ValueError("only a single SELECT is allowed")
        for name in self.relations():
            if re.search(rf"\b{name}\b", bare):
                self.relation(name).createOrReplaceTempView(name)
        return self.spark.sql(text.rstrip().rstrip(";"))

    def call(self, tool: str, **params) -> DataFrame:
        """Run one of TOOLS; parameters that it doesn't have, or lacks, are an error.

        ``path``, ``repo`` and ``name`` keep the rows with that value.
        """
        if tool not in TOOLS:
            raise ValueError(f"unknown tool {tool!r}")
        report, allowed = TOOLS[tool]
        if unknown := set(params) - set(allowed):
            raise ValueError(f"{tool} has no {sorted(unknown)}")
        if tool == "sql":
            return self.sql(params["text"])
        if tool in ("query", "semantic_search"):
            return self.search(params["text"], int(params.get("limit", 10)), tool == "query")
        d = self.report(report)
        for k, v in params.items():
            if k not in d.columns:
                raise ValueError(f"{tool} has no {k}")
            d = d.filter(d[k] == v)
        return d

    def search(self, text: str, k: int = 10, lexical_too: bool = True) -> DataFrame:
        """Documents for a question, by hashed vectors, or fused with the lexical ranking."""
        from repolith.operators import search

        docs = self.relation("docs")
        if lexical_too:
            return search.hybrid(docs, "doc_id", "text", [text], k)
        return search.fused([search.semantic(search.hashed_vectors(docs, "doc_id", "text"), "doc_id", [text])], "doc_id", k)

    def reports(self) -> list[str]:
        return sorted(_reports())

    def report(self, name: str) -> DataFrame:
        return _reports()[name](self.spark, self.folder)


def _reports() -> dict:
    from repolith.plans import ALL

    return {k: v for m in ALL for k, v in m.QUERIES.items()}
