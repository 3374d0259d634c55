"""The stages one by one: what they keep, and that columns, nulls and clashing names pass."""

import random

import brute
import corpus_pipeline as pipeline
import pytest

SMALL = "/root/testdata/sf0.001"


def stage(name):
    return dict(pipeline.STAGES)[name]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    passage = " ".join(f"p{rng.random()}" for _ in range(60))
    text = lambda k: " ".join(f"w{rng.randrange(500)}" for _ in range(k))
    rows = [(i, text(60), "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, None) for i in range(60)]
    rows += [(100 + i, f"{text(30)}\n{passage}  {text(30)}", "de", "s0", 5) for i in range(6)]
    rows += [(200, rows[3][1], "en", "s1", 1), (200, rows[3][1], "en", "s1", 1), (None, None, None, None, None), (None, "a b", "en", "s1", 3), (201, "", "en", "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES[:-1]])
def test_columns_stay(spark, docs, name):
    got = stage(name)(spark, docs, SMALL)
    assert got.columns == docs.columns
    assert got.dtypes == docs.dtypes
    wider = docs.withColumn("kept", docs["doc_id"]).withColumn("component_id", docs["lang"])
    assert stage(name)(spark, wider, SMALL).columns == wider.columns
    assert stage(name)(spark, docs.where("doc_id = -1"), SMALL).count() == 0


def test_one_of_each_class_stays(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute.jaccard([r for r in rows if r[0] is not None])
    got = [r.doc_id for r in stage("near_duplicates")(spark, docs, SMALL).collect()]
    assert sorted(i for i in got if i is not None) == sorted({c for _, c in want.values()})
    assert got.count(None) == 2


def test_differing_texts_of_an_id_stay(spark, docs):
    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    rows = [(3, text("a")), (7, text("a")), (7, text("b")), (7, text("c")), (7, text("c")), (9, text("b") + " more"), (None, text("a"))]
    table = spark.createDataFrame([(i, t, "en", "s0", 1) for i, t in rows], docs.schema).repartition(3)
    got = [(r.doc_id, r.text) for r in stage("near_duplicates")(spark, table, SMALL).collect()]
    assert sorted(got, key=repr) == sorted([(3, text("a")), (7, text("b")), (7, text("c")), (None, text("a"))], key=repr)


def test_passages_are_cut(spark, docs):
    got = {r.doc_id: r for r in stage("repeated_passages")(spark, docs.where("doc_id >= 100 AND doc_id < 200"), SMALL).collect()}
    before = {r.doc_id: r for r in docs.collect()}
    assert got[100].text == before[100].text and got[100].n_chars == len(before[100].text)
    for i in range(101, 106):
        assert len(got[i].text.split()) == 60 and got[i].lang == "de" and got[i].source == "s0"
        assert got[i].text.split() == before[i].text.split()[:30] + before[i].text.split()[90:]


def test_run(spark):
    got = pipeline.run(spark, SMALL)
    rows = got.collect()
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(got.columns) and len(rows) > 50
    # the stages by hand give the same rows
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, f in pipeline.STAGES:
        docs = f(spark, docs, SMALL)
    assert sorted(map(repr, docs.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(
        map(repr, got.select("doc_id", "start", "length", "ids_crc32").collect())
    )


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "repeated_passages"])
def test_columns_of_any_name_and_type_pass(spark, docs, name):
    """Names the stages use themselves, timestamps to the microsecond, binary, decimals, arrays; with a repeated id."""
    extra = {
        "_key": "cast(doc_id as string)", "_again": "true", "_m": "3", "_row": "'r'", "at": "timestamp'2024-05-06 07:08:09.123456'",
        "local": "timestamp_ntz'2024-05-06 07:08:09.123456'", "raw": "X'00FF'", "price": "cast('1234567890.123456789' as decimal(30,9))",
        "parts": "array(1.5D, null)", "day": "date'2024-02-29'",
    }
    from pyspark.sql import functions as F

    wide = docs.withColumns({c: F.expr(e) for c, e in extra.items()})
    got = stage(name)(spark, wide, SMALL)
    assert got.dtypes == wide.dtypes
    before = {r.doc_id: r for r in wide.collect()}
    rows = got.collect()
    assert len(rows) >= 60
    assert all([r[c] for c in extra] == [before[r.doc_id][c] for c in extra] for r in rows if r.doc_id is not None)
