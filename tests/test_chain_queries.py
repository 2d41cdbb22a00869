"""The clustering queries on larger and odd tables of customers: no nation meets itself, and pairs are made once."""

import re

import pytest

from isolates.operators import components
from isolates.plans import cohort_queries, registry
from isolates.plans.fixtures import run_sql


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    """600 customers of three nations, many of one balance, some without a nation."""
    folder = str(tmp_path_factory.mktemp("customers"))
    rows = spark.range(600).selectExpr("id AS c_custkey", "'x' AS c_name", "CAST(IF(id % 50 = 7, NULL, id % 3) AS INT) AS c_nationkey", "CAST((id * id) % 1700 - 300 AS DOUBLE) AS c_acctbal", "'m' AS c_mktsegment")
    rows.write.parquet(f"{folder}/customer.parquet")
    return folder


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_those_of_the_sql_and_meet_by_equal_places(spark, customers):
    found = cohort_queries._chain(spark, customers)[1]
    want = run_sql(spark, customers, f"WITH {cohort_queries._CLUSTER_PAIRS} SELECT * FROM cpairs")
    assert found.dtypes == want.dtypes and want.count() > 1500
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    # a join with an order in its condition pairs all customers of a nation
    assert not [line for line in plan(found).splitlines() if "Join" in line and re.search(r" (<|<=|>|>=) ", line)]


@pytest.mark.parametrize("name", ["distance_rows", "cohort_checks", "cluster_summary"])
def test_pairs_are_written_once(spark, customers, name):
    assert " % 7)" not in plan(registry.QUERIES[name](spark, customers))


def test_rounds_of_the_forest_compare_numbers(spark, customers, monkeypatch):
    seen = []
    plain = cohort_queries.H.materialise
    monkeypatch.setattr(cohort_queries.H, "materialise", lambda df, name: seen.append((name, dict(df.dtypes))) or plain(df, name))
    got = registry.QUERIES["spanning_forest"](spark, customers)
    assert all(set(kinds.values()) == {"bigint"} for name, kinds in seen if name in ("forest", "chosen", "trees")) and len(seen) > 4
    # as many edges as there are nodes less trees
    links = cohort_queries._chain(spark, customers)[1].filter("shared_callable_sites >= 3000000 and snps <= 3")
    members = components.components_of_chains(links, "sample_a", "sample_b")
    assert got.count() == members.count() - members.select("component").distinct().count()


def test_clusters_at_agree_with_each_threshold_alone(spark, customers, monkeypatch):
    stars = []
    monkeypatch.setattr(cohort_queries.H, "connected_components", lambda *a: stars.append(a), raising=False)
    found = registry.QUERIES["clusters_at"](spark, customers).collect()
    samples, pairs = cohort_queries._chain(spark, customers)
    for t in (0, 2):
        want = cohort_queries.H.cluster_members(samples, pairs, t).collect()
        assert sorted((r.sample_id, r.cluster_id or "") for r in found if r.threshold == t) == sorted((r.sample_id, r.cluster_id or "") for r in want)
    assert not stars
