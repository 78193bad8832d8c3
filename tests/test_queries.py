"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry
from levelmark.workload.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, folder, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES.get(name), folder) is None


def test_entry_counts_agree_with_the_fixture(spark):
    counts = {r["bucket"]: (r["n_rows"], r["n_courses"]) for r in entry.entry(spark).collect()}
    assert counts == {
        "irrelevant": (4824, 1431),
        "r1_valid": (96, 92),
        "r2_valid": (108, 106),
        "r2_invalid": (459, 398),
        "r2_untagged": (97, 87),
    }


def test_every_query_has_a_sql_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


JOINING = [
    "relevance_flag", "route_relevance", "join_semi_in_sector", "join_anti_irrelevant", "join_level_lookup",
    "join_left_descr", "join_left_r2", "join_left_meta", "join_first_match", "join_outer_violations", "agg_violations",
    "coalesce_descr", "extract_list_skills", "two_round_summary", "round1", "round2", "prompt_r1", "prompt_r2",
    "score_lexical", "resume_equals_full",
]


@pytest.mark.parametrize("name", JOINING)
def test_query_with_nothing_broadcast_and_hot_keys(spark, con, folder, name):
    """The paths for large tables: no lookup fits, many keys are hot."""
    forced = {"broadcastRows": "0", "hotRows": "9", "salts": "5"}
    for key, value in forced.items():
        spark.conf.set(f"spark.levelmark.{key}", value)
    try:
        assert compare(spark, con, name, QUERIES[name], ORACLES[name], folder) is None
    finally:
        for key in forced:
            spark.conf.unset(f"spark.levelmark.{key}")
