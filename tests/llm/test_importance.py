"""Importance resampling against a plain model and SQL; quickselect against sorting."""

import random

import brute
import duckdb
import pytest
from pyspark.sql import functions as F
from test_operators import awkward, frame, same

from veilink.llm import importance, registry

SMALL = "/root/testdata/sf0.001"


def target_of(spark, texts):
    return spark.createDataFrame([(t, 1) for t in texts], "text string, doc_id long")


TARGET = ["w1 w2 w3 w1 W1", None, "", "É é the THE 42x", "w7-w8_w9 a|b"]


@pytest.mark.parametrize(("percent", "most"), [(10, 1), (33, 2), (100, 1), (0, 1)])
def test_against_a_plain_model(spark, percent, most):
    rows = awkward() + [(40, "w1 " * 30), (40, "w1 " * 30), (40, "w1 " * 31), (41, None), (None, "w5 " * 50)]
    got = importance.resample(frame(spark, rows), target_of(spark, TARGET), percent=percent, most_words=most)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    same([tuple(r) for r in got.collect()], brute.resample(rows, TARGET, percent=percent, most=most))


def test_equal_rows_at_the_last_place(spark):
    """More rows equal the k-th one than there is room for."""
    rows = [(7, "a b c " * 10)] * 50 + [(8, "a b d " * 10)] * 50
    got = [tuple(r) for r in importance.resample(frame(spark, rows), target_of(spark, ["a"]), percent=30).collect()]
    same(got, brute.resample(rows, ["a"], percent=30))
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 31))


def test_resampling_moves_towards_the_target(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["red", "blue", "green"], [1 + 8 * (i % 4 == 0), 9, 9], k=60))) for i in range(800)]
    got = importance.resample(frame(spark, rows), target_of(spark, ["red red red blue"] * 20), percent=20).collect()
    drawn = [r.doc_id for r in got if r.rank]  # a quarter of all documents has many of the target's words
    assert len(drawn) == 160 and sum(1 for i in drawn if i % 4 == 0) > 0.4 * len(drawn)


def test_kth_key(spark):
    rng = random.Random(9)
    values = [rng.choice([5, 5, 5, rng.randrange(1000)]) for _ in range(3000)]
    table = spark.createDataFrame([(v, v % 3) for v in values], "a long, b long").repartition(5)
    want = sorted((v, v % 3) for v in values)
    for k in (1, 700, 3000):
        assert importance.kth_key(table, k, F.struct("a", "b"), pivots=2) == want[k - 1]
    assert importance.kth_key(table, 0, F.struct("a", "b")) is None
    assert importance.kth_key(table, 3001, F.struct("a", "b")) is None


def test_empty_tables(spark):
    docs = frame(spark, [(1, "x")])
    assert importance.resample(docs.where("doc_id < 0"), target_of(spark, TARGET)).count() == 0
    alone = importance.resample(docs, target_of(spark, TARGET).where("doc_id < 0")).collect()
    assert [tuple(r) for r in alone] == brute.resample([(1, "x")], [])


def test_sql_on_awkward_rows(spark):
    rows = awkward(5) + [(40, "w1 " * 30), (None, "w5 " * 50), (41, "z" * 300 + " ")]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    con.execute("create table benchmark (text varchar)")
    con.executemany("insert into benchmark values (?)", [(t,) for t in TARGET])
    same(con.execute(importance.SQL).fetchall(), brute.resample(rows, TARGET))


def test_registered(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    got = registry.op11_importance_resampling(spark, SMALL)
    assert [t for _, t in got.dtypes] == ["bigint"] * 5
    same([tuple(r) for r in got.collect()], con.execute(importance.SQL).fetchall())
