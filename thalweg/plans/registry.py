"""All queries of the core."""

from __future__ import annotations

from collections.abc import Callable

from thalweg.plans import data_queries, survey_queries, survey_sql

FLAGSHIP = "watershed_summary"


def queries() -> dict[str, Callable]:
    return {**survey_queries.QUERIES, **data_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**survey_sql.SQL, **data_queries.SQL}
