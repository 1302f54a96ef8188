from __future__ import annotations

import __spark_entry__
from loreweave.plans import oracle, queries


def test_entry_runs(spark):
    out = __spark_entry__.entry(spark)
    assert set(out.columns) == {"entity_id", "canonical_name", "entity_type", "first_seen_passage", "mention_count"}


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(oracle.ORACLE_SQL)
