"""Catalogue of queries over the test tables, with the SQL that states each result."""

from __future__ import annotations

from weftspark.plans import q_matching, q_metrics, q_profile, q_projection, q_relational, q_schema, q_sources, q_synth, q_text
from weftspark.plans.registry import Query

MODULES = (q_projection, q_relational, q_profile, q_metrics, q_schema, q_matching, q_sources, q_synth, q_text)


def queries() -> dict[str, Query]:
    return {name: fn for m in MODULES for name, fn in m.CATALOG.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.CATALOG.sql.items()}
