"""Every registered query and its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from glossa.session import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function (spark, sf_dir) under its name, with SQL that DuckDB runs on the same tables."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


from glossa.plans import candidate_queries, corpus_queries, decision_queries, document_queries, evaluation_queries, import_queries, language_queries, pack_queries, retrieval_queries, review_queries, serving_queries, signal_queries, source_queries, suggest_queries, text_queries  # noqa: E402, F401
