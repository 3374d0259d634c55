import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from veilink.operators.corrupt import Roles
from veilink.plans import catalog, linkage, oracle
from veilink.plans.people import people_of, side_a, side_b
from veilink.sources.sweep import ErrorWeights, LinkConfig

SMALL = "/root/testdata/sf0.001"
CHECKED = [
    "people_base", "register_join", "config_grid", "config_parse", "stratified_sample", "error_buckets",
    "corrupt_all", "bigrams", "hash_enhanced", "encode_abf", "encode_rlb", "encode_block30", "tree_two_levels",
    "tree_leaves", "link_exhaustive", "candidate_map", "roc_points", "pair_verdicts", "report_by_error",
    "report_gold", "sweep_links", "synthetic_base", "hash_triple", "link_tree_triple", "link_repeated_ids", "candidate_pairs",
    "pair_verdicts_copies", "slice_ties", "folder_scan", "append_results", "register_join", "sweep_from_file", "candidate_map_copies", "append_runs",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not mounted")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sql, name):
    found = contract.queries()[name](spark, SMALL)
    cursor = sql.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    assert normal([tuple(r) for r in found.collect()], found.columns) == normal(cursor.fetchall(), columns)


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(catalog.all_queries()) == set(oracle.all_sql())


@pytest.mark.parametrize("encoding", ["ABF", "CLK", "RLB"])
def test_undamaged_records_are_found(spark, encoding):
    people = people_of(spark, SMALL)
    config = LinkConfig(
        1, m=200, k=2, hash="TripleHash", encoding=encoding, rlb_share=0.4, weights=ErrorWeights(groups=(1, 0, 0, 0, 0, 0))
    )
    links = linkage.link_synthetic(side_a(people), side_b(people), [config], Roles())
    partnered = links.matches.where("has_partner")
    assert partnered.where((F.col("hit") == 0) | (F.col("dice") != 1.0)).count() == 0
    report = links.report_by_error(denominator="true_matches").collect()
    assert [r.Tipo_erro for r in report] == ["Sem erro"] and report[0].pair_completeness == 1.0


def test_configurations_share_an_index(spark):
    people = people_of(spark, SMALL)
    mild, hard, other = (
        LinkConfig(1, hash="DoubleHash", weights=ErrorWeights.evenly(0.02)),
        LinkConfig(2, hash="DoubleHash", weights=ErrorWeights.evenly(0.1)),
        LinkConfig(3, hash="DoubleHash", encoding="ABF", weights=ErrorWeights.evenly(0.1)),
    )
    assert linkage.shared_index([mild, hard, other]) == {1: 1, 2: 1, 3: 3}
    together = linkage.link_synthetic(side_a(people), side_b(people), [mild, hard, other])
    columns = ["id", "error_type", "best_a", "dice", "hit"]
    for config in (mild, hard, other):
        alone = linkage.link_synthetic(side_a(people), side_b(people), [config])
        mine = together.matches.where(F.col("config_id") == config.config_id).select(*columns).collect()
        assert sorted(mine) == sorted(alone.matches.select(*columns).collect())
    report = together.report_by_error().groupBy("config_id").agg(F.max("tam_baseB").alias("b")).collect()
    assert {r.config_id: r.b for r in report} == {1: 150, 2: 150, 3: 150}
