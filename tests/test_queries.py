"""Named queries against their DuckDB oracles on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference

SF = "/root/testdata/sf0.001"
CHECKED = (
    "parse_auto", "ip_normalize", "allow_bounds", "allow_semi_audit", "allow_longest_rule", "detect_error_flood", "detect_sensitive_path",
    "rule_first_match", "threat_scan", "threat_upsert", "list_threats", "prose_matches",
)


def test_every_query_has_an_oracle():
    from catalogue.queries import QUERIES

    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_oracle(spark, name):
    assert difference(spark, connect(SF), SF, entry.queries()[name], entry.oracle_sql()[name]) is None
