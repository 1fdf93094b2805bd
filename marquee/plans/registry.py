"""Named queries: ``name -> (callable(spark, sf_dir) -> DataFrame, oracle SQL)``.

The oracle is an independent DuckDB statement over the same input tables
(``None`` when the operator is numerical and is checked by pytest instead).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def round6_sql(sql: str) -> str:
    """Rewrite every ``round(expr, 6)`` into the IEEE form used by ``r6``."""
    out, i, key = [], 0, "round("
    while True:
        j = sql.find(key, i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        depth, k, last_comma = 1, j + len(key), None
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                last_comma = k
            k += 1
        inner_end = k - 1
        if last_comma is not None and sql[last_comma + 1:inner_end].strip() == "6":
            expr = round6_sql(sql[j + len(key):last_comma])
            out.append(sql[i:j])
            out.append(f"(CASE WHEN abs({expr}) < 1e12 THEN floor(({expr}) * 1000000.0 + 0.501) / 1000000.0 "
                       f"ELSE ({expr}) END)")
        else:
            out.append(sql[i:j + len(key)])
            k = j + len(key)
        i = k


def bigint_counts_sql(sql: str) -> str:
    """DuckDB's ``count_if`` returns HUGEINT; cast it to BIGINT like Spark's."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = bigint_counts_sql(sql[j + len(key):k - 1])
        out.append(sql[i:j])
        out.append(f"CAST(count_if({inner}) AS BIGINT)")
        i = k


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, bigint_counts_sql(round6_sql(sql)) if sql else None)
        return fn
    return deco


def load_all() -> dict[str, tuple[QueryFn, str | None]]:
    # importing the modules fills REGISTRY
    from marquee.plans import (  # noqa: F401
        analytics_queries, browse_queries, cleaning_queries, content_queries,
        collab_queries, linkage_queries, source_queries,
    )
    return REGISTRY
