"""Syntax checks for six languages."""

from repolith.llm.syntax.languages import EXTENSIONS, LANGUAGES, parses, ranking

__all__ = ["EXTENSIONS", "LANGUAGES", "parses", "ranking"]
