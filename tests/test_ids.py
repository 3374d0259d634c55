"""Linkage where ids are of any type, repeat, go by another name, or A is empty."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilink.operators import encode as encoding
from veilink.operators.corrupt import Roles
from veilink.operators.encode import codebook, encode
from veilink.operators.rows import rows_between, with_ordinal
from veilink.plans.linkage import link_exhaustive, link_gold, link_synthetic
from veilink.sources import store
from veilink.sources.sweep import CLK, LinkConfig

ATTRS = ["name", "guardian", "birth_date", "city_code"]
CONFIG = LinkConfig(1, m=60, k=2, hash="DoubleHash", encoding=CLK)


def people(spark, n=40, kind="bigint"):
    rows = [(i, f"NAME{i * 37 % 101} A{i}", f"GUARD{i * 53 % 97}", f"{i % 28 + 1:02d}/03/19{i % 90 + 10}", str(1000 + i)) for i in range(n)]
    frame = spark.createDataFrame(rows, "id bigint, name string, guardian string, birth_date string, city_code string")
    return frame.withColumn("id", F.lpad(F.col("id").cast("string"), 4, "0") if kind == "string" else F.col("id").cast(kind))


def gold(b):
    return b.withColumn("check", F.col("id"))


@pytest.mark.parametrize("kind", ["int", "bigint", "string"])
def test_ids_of_any_type(spark, kind):
    a = people(spark, 40, kind)
    links = link_gold(a, gold(a), ATTRS, [CONFIG])
    assert links.matches.schema["best_a"].dataType == a.schema["id"].dataType
    rows = links.matches.collect()
    assert len(rows) == 40 and all(r.best_a == r.id and r.dice == 1.0 for r in rows)
    assert links.report_overall().count() == 1
    pairs = links.candidate_pairs(["id"])
    assert pairs.where("id = id_a").count() == 40
    found = link_exhaustive(a, gold(a).withColumn("truth", F.col("id")), ATTRS, [CONFIG], ["id", "truth"])
    assert found.where("id = best_a").count() == 40


def test_repeated_ids_are_searched_row_by_row(spark):
    a = people(spark)
    extra = a.where("id = 3").withColumn("name", F.lit("QUITE ANOTHER")).withColumn("guardian", F.lit("SOMEBODY"))
    links = link_gold(a, gold(a.unionByName(extra)), ATTRS, [CONFIG])
    rows = links.matches.collect()
    assert len(rows) == 41
    assert sorted(r.dice == 1.0 for r in rows if r.id == 3) == [False, True]
    assert links.size_a().first().size_a == 40


def test_repeated_ids_of_a(spark):
    a = people(spark).withColumn("ord", F.col("id"))
    later = a.where("id = 3").withColumn("name", F.lit("QUITE ANOTHER")).withColumn("ord", F.lit(1000).cast("bigint"))
    both = a.unionByName(later)
    kept = link_gold(both, gold(both.drop("ord")), ATTRS, [CONFIG])
    assert kept.size_a().first().size_a == 41
    assert all(r.dice == 1.0 for r in kept.matches.collect())
    last = link_gold(both, gold(both.drop("ord")), ATTRS, [CONFIG], last_of_id=True)
    assert last.size_a().first().size_a == 40
    assert sum(r.dice != 1.0 for r in last.matches.collect()) == 1
    assert last.verdicts().count() == 41
    with pytest.raises(ValueError):
        link_gold(both.drop("ord"), gold(both), ATTRS, [CONFIG], last_of_id=True)


def test_one_id_with_a_third_of_a(spark):
    """Verdicts and candidate maps where one id stands behind many filters, against the records of each leaf."""
    a = people(spark, 90).withColumn("ord", F.col("id"))
    shared = a.where("id % 3 = 0").withColumn("ord", F.col("id") + 1000).withColumn("id", F.lit(7).cast("bigint"))
    a = a.unionByName(shared)  # each of these records is an exact copy of another one
    b = people(spark, 90).withColumn("check", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")))
    links = link_gold(a, b, ATTRS, [CONFIG])
    records = [(r.id, r.ord, tuple(r.words)) for r in links.encoded.a.frame.collect()]
    filters = {r.id_a: tuple(r.words) for r in links.encoded.distinct.filters.frame.collect()}
    threshold = links.summary().first().threshold
    verdicts = links.verdicts()
    assert "collect_set" not in verdicts._jdf.queryExecution().toString()
    got = {r.id: (r.VP, r.FP, r.VN, r.FN) for r in verdicts.collect()}
    single = lambda x: float(np.float32(x))
    matches = {r.id: r for r in links.matches.collect()}
    for i, m in matches.items():
        leaf = {filters[c.id_a]: c.dice for c in m.candidates}
        own = [single(leaf[w]) for k, _, w in records if w in leaf and k == m.truth]
        every = [single(leaf[w]) for _, _, w in records if w in leaf]
        vp, fn = int(bool(own) and max(own) >= threshold), int(bool(own) and max(own) < threshold)
        high = sum(x >= threshold for x in every)
        assert got[i] == (vp, high - vp, len(every) - high - fn, fn)
    for entries in (65_536, 1):
        maps = links.candidate_maps(["id"], entries=entries).collect()
        for i, m in matches.items():
            leaf = {filters[c.id_a]: c.dice for c in m.candidates}
            want = {k: single(leaf[w]) for k, _, w in sorted(records, key=lambda r: (r[0], r[1])) if w in leaf}
            mine = [r for r in maps if r.id == i]
            assert sorted(r.part for r in mine) == list(range(mine[0].parts))
            merged = {k: v for r in mine for k, v in r.busca.pares_candidatos.items()}
            assert merged == want and sum(len(r.busca.pares_candidatos) for r in mine) == len(want)
            assert all(r.busca.baseA == m.best_a for r in mine)
        assert (max(r.parts for r in maps) > 1) == (entries == 1)


def test_key_of_another_name(spark):
    a = people(spark).withColumnRenamed("id", "pid")
    links = link_synthetic(a, a, [CONFIG], Roles(key="pid"))
    assert links.matches.count() == 40
    assert links.report_by_error().count() >= 1


def test_empty_a_keeps_all_of_b(spark):
    a = people(spark)
    links = link_gold(a.where("id < 0"), gold(a), ATTRS, [CONFIG])
    rows = links.matches.collect()
    assert len(rows) == 40
    assert all(r.best_a is None and r.dice is None and r.candidates == [] and not r.hit for r in rows)


def test_encoding_by_look_up_and_by_join(spark, monkeypatch):
    a = people(spark, 200).withColumn("guardian", F.when(F.col("id") % 5 == 0, F.concat(F.lit("Çé 日本 😀"), "guardian")).otherwise(F.col("guardian")))
    a = a.withColumn("name", F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("name")))
    a = a.unionByName(a.where("id < 5")).unionByName(a.where("id = 7").select(*[F.lit(None).cast(t).alias(c) if c != "id" else "id" for c, t in a.dtypes]))
    book = codebook([a], [ATTRS], [CONFIG])
    near = encode(a, ATTRS, [CONFIG], book, ["id"])
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Generate", "MapInArrow", "Join"))
    near = sorted(near.collect())
    monkeypatch.setattr(encoding, "LETTERS_BYTES", 0)
    far = codebook([a], [ATTRS], [CONFIG])
    assert far.letters is None
    assert near == sorted(encode(a, ATTRS, [CONFIG], far, ["id"]).collect()) and len(near) == 206


def test_encoding_of_several_configurations(spark, monkeypatch):
    """Each configuration has its own look-up; an attribute without any value and bigrams outside the book set no bits."""
    a = people(spark, 40).withColumn("guardian", F.lit(None).cast("string"))
    configs = [LinkConfig(3, m=100, k=2, hash="DoubleHash"), LinkConfig(7, m=200, k=3, hash="DoubleHash", encoding="ABF")]
    book = codebook([a.where("id < 20")], [ATTRS], configs)
    near = sorted(encode(a, ATTRS, configs, book, ["id"]).collect())
    monkeypatch.setattr(encoding, "LETTERS_BYTES", 0)
    far = sorted(encode(a, ATTRS, configs, codebook([a.where("id < 20")], [ATTRS], configs), ["id"]).collect())
    assert near == far and len(near) == 80


def test_slices_share_one_tie_rule(spark):
    rows = spark.range(0, 12000, 1, 7).select(F.lit(1).alias("k"), F.col("id"), (F.col("id") % 3).alias("x"))
    want = [(1, i, i % 3) for i in range(12000)]
    assert sorted(map(tuple, rows_between(rows, 0, 50, ["k"]).collect())) == want[:50]
    assert sorted(map(tuple, rows_between(rows, 9990, 10010, ["k"]).collect())) == want[9990:10010]
    numbered = with_ordinal(rows, ["k"])
    assert numbered.where("ordinal <> id").count() == 0
    # what is left after the writing job: sizes of the ranges, and a broadcast of them
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_part") == 1 and plan.count("Exchange") == 3


def test_scratch_folder(spark, tmp_path):
    with store.scratch(spark):
        kept = store.store(spark.range(5).toDF("x"), "try")
        path = kept.frame.inputFiles()[0]
        assert kept.rows == 5
    assert not (tmp_path.__class__(path.removeprefix("file:")).exists())
    again = store.store(spark.range(5).toDF("x"), "try")
    path = again.frame.inputFiles()[0]
    again.drop()
    assert not (tmp_path.__class__(path.removeprefix("file:")).exists())


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        store.checkpoint_root(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError):
        store.checkpoint_root(Session())


def test_encoding_of_a_sweep_by_array(spark):
    """Rows of several configurations are looked up a batch at a time: the filters of the expression, values of all kinds."""
    odd = ["", None, "Çé 日本 😀", "_", "A", "😀😀"]
    a = people(spark, 60).withColumn("guardian", F.get(F.array(*[F.lit(x).cast("string") for x in odd]), (F.col("id") % 7).cast("int")))
    a = a.withColumn("city_code", F.col("id").cast("int")).repartition(3)
    configs = [LinkConfig(3, m=100, k=2, hash="DoubleHash"), LinkConfig(7, m=200, k=3, hash="DoubleHash", encoding="ABF")]
    swept = encode(a, ATTRS, configs, codebook([a], [ATTRS], configs), ["id"])
    plan = swept._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "lambda" not in plan and "Exchange SinglePartition" not in plan
    got = {(r.config_id, r.id): r.words for r in swept.collect()}
    for config in configs:
        alone = encode(a, ATTRS, [config], codebook([a], [ATTRS], [config]), ["id"]).collect()
        assert len(alone) == 60
        for r in alone:
            words = got[config.config_id, r.id]
            assert words[: len(r.words)] == r.words and not any(words[len(r.words) :])
    none = encode(a.where("id < 0"), ATTRS, configs, codebook([a.where("id < 0")], [ATTRS], configs), ["id"])
    assert none.count() == 0
