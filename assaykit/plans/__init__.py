"""The registered queries of the engine's own operators."""

from __future__ import annotations

from assaykit.plans import corpus, documents, extraction, keyed, numeric, report, tools, verdicts  # noqa: F401  they register
from assaykit.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(sorted(QUERIES.items()))


def oracle_sql() -> dict[str, str]:
    return dict(sorted(SQL.items()))
