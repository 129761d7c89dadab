"""All core queries and their SQL: one entry for each operator, over whole tables."""
from __future__ import annotations

from gristmill.plans import curation, evaluation, pipeline, reports, rules


def queries() -> dict:
    return {**rules.QUERIES, **curation.QUERIES, **evaluation.QUERIES, **pipeline.QUERIES, **reports.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**rules.SQL, **curation.SQL, **evaluation.SQL, **pipeline.SQL, **reports.SQL}
