import json

import pytest
from pyspark.sql import functions as F

from veilink.operators.corrupt import ERROR_LABELS, append_unpartnered, error_types, inject_errors
from veilink.operators.rows import rows_between, with_ordinal, zip_rows
from veilink.operators.sampling import strata, stratified_sample
from veilink.operators.synth import day_grid, with_synthetic_date
from veilink.plans.base_builder import synthetic_base, with_city_code
from veilink.sources import sweep, tables
from veilink.sources.store import checkpoint_root, store


def test_checkpoint_folder_is_the_session_one(spark):
    assert checkpoint_root(spark) == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())
    kept = store(spark.range(10), "numbers", top=F.max("id"))
    assert (kept.rows, kept.seen["top"], kept.frame.count()) == (10, 9, 10)


def test_delimited_files(spark, tmp_path):
    rows = [(1, "JOSÉ", "01/02/1990"), (2, "ÉRICA", None)]
    base = spark.createDataFrame(rows, "ID bigint, NOME string, data_nasc string")
    tables.write_base(base, str(tmp_path / "base"))
    again = tables.read_delimited(spark, str(tmp_path / "base"), schema=base.schema)
    assert sorted(map(tuple, again.collect())) == rows
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "one.csv").write_text("a;b\n1;x\n", encoding="utf-8")
    (tmp_path / "many" / "two.csv").write_text("a;b\n2;y\n3;z\n", encoding="utf-8")
    folder = tables.read_folder(spark, str(tmp_path / "many"), "a int, b string", sep=";")
    assert sorted(map(tuple, folder.collect())) == [(1, "x", "one"), (2, "y", "two"), (3, "z", "two")]
    named = tables.folder_tables(spark, str(tmp_path / "many"), "a int, b string", ["one", "two"], sep=";")
    assert {k: v.count() for k, v in named.items()} == {"one": 1, "two": 2}


def test_results_are_appended_by_error_type(spark, tmp_path):
    results = spark.createDataFrame([(1, "Sem erro"), (2, "tipo 1")], "VP int, Tipo_erro string")
    for _ in range(2):
        tables.append_results(results, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.where("Tipo_erro = 'tipo 1'").count() == 2


def test_a_run_that_is_repeated_stands_once(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = spark.createDataFrame([(1, "tipo 1"), (2, "tipo 2"), (3, "tipo 2")], "id bigint, Tipo_erro string")
    for part, run in ((rows, "a/1"), (rows, "b"), (rows.where("id < 3"), "a/1"), (rows.where("id = 1"), "a/1")):
        tables.append_results(part, path, run=run)
    tables.append_results(rows.where("id = 3"), path + "2")
    tables.append_results(rows.where("id = 3"), path + "2")
    found = tables.read_delimited(spark, path, schema="id bigint, Tipo_erro string, run string")
    assert sorted((r.run, r.id) for r in found.collect()) == [("a/1", 1), ("b", 1), ("b", 2), ("b", 3)]
    assert tables.read_delimited(spark, path + "2", schema="id bigint, Tipo_erro string").count() == 2


def test_normalised_columns(spark):
    raw = spark.createDataFrame([("a", "3550308.0"), ("b", ""), ("c", "17")], "`NOME X` string, code string")
    clean = tables.normalise_columns(raw, {"NOME X": "NOME"}, upper=["NOME"], integers=["code"])
    assert sorted(map(tuple, clean.collect())) == [("A", 3550308), ("B", None), ("C", 17)]


def test_grid_and_files(spark, tmp_path):
    grid = sweep.grid(spark)
    configs = sweep.to_configs(grid)
    assert [c.config_id for c in configs] == list(range(1, 28))
    assert [(c.m, c.encoding, c.weights.error_share) for c in configs[:4]] == [
        (100, "ABF", 0.1), (100, "ABF", 0.25), (100, "ABF", 0.5), (100, "CLK", 0.1),
    ]
    assert {c.rlb_share for c in configs if c.encoding == "RLB"} == {0.4}
    sweep.append_configs(grid, str(tmp_path / "sweep"))
    assert sweep.to_configs(sweep.read_configs(spark, str(tmp_path / "sweep"), lines=True)) == configs
    weights = {k: 0.1 for k in sweep.GROUP_KEYS + sweep.SUPPRESS_KEYS + sweep.WORD_KEYS}
    one = {"tamanho_BF": 200, "quant_hash": 3, "tipo_hash": "DoubleHash", "peso_erro": weights}
    text = {"config9": one | {"tipo_bloom": {"nome": "CLK", "A": "x", "B": "y"}}}
    (tmp_path / "one.json").write_text(json.dumps(text, indent=1))
    read = sweep.read_configs(spark, str(tmp_path / "one.json"))
    (config,) = sweep.to_configs(read)
    assert (config.config_id, config.m, config.k, config.size) == (9, 200, 3, 800)
    row = sweep.sizes(read, 4).first()
    assert (row["size"], row.rlb_share, row.error_share) == (800, 0.0, 0.9)


def test_ordinals_spread_ties(spark):
    rows = spark.range(1000).withColumn("k", F.when(F.col("id") < 700, 5).otherwise(F.col("id")))
    numbered = with_ordinal(rows, ["k"]).collect()
    assert sorted(r.ordinal for r in numbered) == list(range(1000))
    by_key = [r.k for r in sorted(numbered, key=lambda r: r.ordinal)]
    assert by_key == sorted(by_key)
    assert sorted(r.id for r in rows_between(spark.range(100), 10, 15, ["id"]).collect()) == [10, 11, 12, 13, 14]
    assert sorted(r.id for r in rows_between(spark.range(100), 0, 3, ["id"]).collect()) == [0, 1, 2]
    pairs = zip_rows(spark.range(5), spark.range(50, 53).toDF("other"), ["id"], [F.desc("other")]).collect()
    assert sorted((r.ordinal, r.id, r.other) for r in pairs) == [(0, 0, 52), (1, 1, 51), (2, 2, 50)]


def test_stratified_sample(spark):
    people = spark.range(4000).withColumn("uf", F.when(F.col("id") % 4 == 0, "A").when(F.col("id") % 4 == 1, "B"))
    one = stratified_sample(people, "uf", 0.25, "id", 1)
    other = stratified_sample(people, "uf", strata(people.where("uf = 'A'"), "uf", 0.25), "id", 1)
    assert {r.id for r in other.collect()} == {r.id for r in one.where("uf = 'A'").collect()}
    assert 150 < other.count() < 350


def test_error_injection(spark):
    rows = [(i, f"ZECA DA SILVA {i}", f"MARIA DE SA {i}", "28/02/2000", str(1000 + i)) for i in range(2000)]
    people = spark.createDataFrame(rows, "id bigint, name string, guardian string, birth_date string, city_code string")
    b = append_unpartnered(people.where("id < 1900"), people.where("id >= 1900"))
    damaged = inject_errors(b, sweep.ErrorWeights.evenly(0.1), 7)
    assert damaged.columns[-1] == "error_type" and damaged.count() == 2000
    assert [r.error_type for r in error_types(damaged).collect()] == sorted(ERROR_LABELS)
    first, second = (sorted(map(tuple, damaged.repartition(n).collect())) for n in (1, 9))
    assert first == second
    clean = {r[0]: r for r in rows}
    for r in damaged.collect():
        changed = [i for i, c in enumerate(("name", "guardian", "birth_date", "city_code"), 1) if r[c] != clean[r.id][i]]
        label = r.error_type
        if label == "Sem erro":
            assert changed == []
        elif label == "tipo 1":
            assert len(changed) == 1 and r[("name", "guardian", "birth_date", "city_code")[changed[0] - 1]] == ""
        elif label == "tipo 2":
            assert changed in ([1], [2])
        elif label == "tipo 3":
            assert r.name.startswith("SECA") and r.guardian.startswith("MARIA SA")
        elif label == "tipo 4":
            assert 0 <= int(r.city_code) - int(clean[r.id][4]) <= 10_000 and set(changed) <= {4}
        else:
            assert set(changed) <= {3}
    shares = {r.error_type: r["count"] for r in damaged.groupBy("error_type").count().collect()}
    assert 900 < shares["Sem erro"] < 1100


def test_synthetic_dates(spark):
    sample = spark.sql("select date_add(date '2000-01-01', cast(id % 50 as int)) d from range(5000)")
    grid = day_grid(sample, "d").first().grid
    assert len(grid) == 101 and grid == sorted(grid) and (grid[0], grid[-1]) == (10957.0, 11006.0)
    drawn = with_synthetic_date(spark.range(3000), sample, "d", "id", 3)
    days = [r.day for r in drawn.selectExpr("unix_date(to_date(data_nasc, 'dd/MM/yyyy')) day").collect()]
    assert min(days) >= 10957 and max(days) <= 11006 and abs(sum(days) / len(days) - 10981.5) < 1


def test_base_builder(spark):
    register = spark.range(3000).select(
        "id", F.when(F.col("id") % 2 == 0, "SP").otherwise("RJ").alias("UF"),
        F.concat(F.lit("N"), "id").alias("NOME"), F.when(F.col("id") % 3 == 0, "X").otherwise("Y").alias("MUNICIPIO"),
    )
    cities = spark.createDataFrame([("x", 1), ("x", 2), ("z", 3)], "MUNICIPIO string, COD_MUNICIPIO int")
    joined = with_city_code(register, cities)
    assert joined.count() == 1000 * 2 + 2000
    dates = spark.sql("select date_add(date '2000-01-01', cast(id as int)) d from range(100)")
    base = synthetic_base(register, cities, dates, "d", "id", fraction=0.2)
    rows = base.collect()
    assert base.columns == ["ID", "COD_MUNICIPIO", "NOME", "NOME_RESPONSAVEL", "data_nasc"]
    assert rows and all(None not in tuple(r) for r in rows) and len({r.ID for r in rows}) == len(rows)


@pytest.mark.parametrize("bad", [{"hash": "MD5"}, {"encoding": "df.select('ID')"}])
def test_configurations_are_checked(bad):
    with pytest.raises(ValueError):
        sweep.LinkConfig(**bad)
