import hashlib

import model
import pytest
from pyspark.sql import functions as F

from veilink.functions import bitwords, damage
from veilink.functions.draws import cut_points, int_draw, unit_draw, weighted_bucket
from veilink.functions.hashing import digest_residue
from veilink.functions.text import with_tokens
from veilink.operators.encode import token_positions
from veilink.sources.sweep import LinkConfig

WORDS = ["__", "_M", "MA", "JO", "É_", "ÇA", "ß_", "A ", "日本"]


def column(spark, values, name="z"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_bigrams(spark):
    rows = [(1, "MARIA", None), (2, "", "É"), (3, None, None)]
    found = with_tokens(spark.createDataFrame(rows, "id int, x string, y string"), ["x", "y"]).collect()
    got = sorted((r.id, r.attr_idx, r.token) for r in found if r.token is not None)
    assert got == sorted([(1, 0, t) for t in model.bigrams("MARIA")] + [(2, 0, "__"), (2, 1, "_É"), (2, 1, "É_")])
    assert {r.id for r in found} == {1, 2, 3}


@pytest.mark.parametrize("modulus", [30, 100, 400, 1600, 9999])
def test_digest_residue(spark, modulus):
    m = F.lit(modulus)
    raw = F.encode("z", "UTF-8")
    found = column(spark, WORDS).select(
        "z",
        digest_residue(F.md5(raw), 32, m).alias("a"),
        digest_residue(F.sha2(raw, 256), 64, m).alias("b"),
        digest_residue(F.sha2(raw, 512), 128, m).alias("c"),
    )
    for r in found.collect():
        for got, family in ((r.a, "md5"), (r.b, "sha256"), (r.c, "sha512")):
            assert got == int(hashlib.new(family, r.z.encode()).hexdigest(), 16) % modulus


@pytest.mark.parametrize("family", ["DoubleHash", "TripleHash", "EnhancedDHash"])
@pytest.mark.parametrize("mode", ["literal", "published"])
def test_positions(spark, family, mode):
    tokens = column(spark, WORDS, "token").withColumn("attr_idx", F.lit(0))
    placed = token_positions(tokens, [LinkConfig(m=100, k=20, hash=family, encoding="ABF")], mode).collect()
    for word in WORDS:
        got = [r.pos for r in sorted(placed, key=lambda r: r.round) if r.token == word]
        assert got == model.positions(word, 20, 100, family, mode)


def test_unknown_names_raise():
    with pytest.raises(ValueError):
        LinkConfig(hash="Other")
    with pytest.raises(ValueError):
        LinkConfig(encoding="Other")
    with pytest.raises(ValueError):
        LinkConfig(encoding="RLB")


DROP = {"MARIA DA SILVA": "MARIA SILVA", "MARIA SILVA": "MARIA", "MARIA": "MARIA", "": "", "MARIA  SILVA": "MARIA SILVA"}
FIRST = {"MARIA DA SILVA": "M. ", "maria": "M. ", " MARIA": " . MARIA", "": "", "ÉRICA": "É. "}
FIRST_INTENDED = {"MARIA DA SILVA": "M. DA SILVA", "MARIA": "M.", "": ""}
SECOND = {"MARIA DA SILVA": "MARIA D. SILVA", "MARIA SILVA": "MARIA S.", "MARIA": "MARIA", "": "", "A éb C": "A É. C"}
SPELL = {
    "JESSE": "JEÇE", "GRAÇA": "GRASSA", "ZECA": "SECA", "KARIN": "CARIN", "THIAGO": "TIAGO", "NEIDE": "NEDE",
    "ANA": "ANNA", "JOAO DE SA": "JOAO SA", "CARRO": "CARO", "YURI": "IURI", "WILMA": "UILMA", "BOB": "BOB", "": "",
    "ZEZE KK": "SESE KK",
}


@pytest.mark.parametrize(
    "rule, cases",
    [
        (damage.drop_second_word, DROP),
        (damage.abbreviate_first, FIRST),
        (lambda z: damage.abbreviate_first(z, "intended"), FIRST_INTENDED),
        (damage.abbreviate_second, SECOND),
        (damage.spelling_variant, SPELL),
    ],
)
def test_string_damage(spark, rule, cases):
    found = column(spark, list(cases) + [None]).select("z", rule(F.col("z")).alias("out")).collect()
    assert {r.z: r.out for r in found} == {**cases, None: None}


def test_shifts(spark):
    dates = {"31/12/1999": "01/01/2000", "28/02/2000": "29/02/2000", "1/3/2001": "02/03/2001", "": "", "x": "x", None: None}
    found = column(spark, list(dates)).select("z", damage.shift_date(F.col("z"), F.lit(1)).alias("out")).collect()
    assert {r.z: r.out for r in found} == dates
    codes = {"10": "15", "": "", None: None, "abc": "abc"}
    found = column(spark, list(codes)).select("z", damage.shift_code(F.col("z"), F.lit(5)).alias("out")).collect()
    assert {r.z: r.out for r in found} == codes


def test_draws_do_not_depend_on_partitions(spark):
    u = unit_draw(7, "x", F.col("id")).alias("u")
    one = {r.id: r.u for r in spark.range(200).coalesce(1).select("id", u).collect()}
    many = {r.id: r.u for r in spark.range(200).repartition(17).select("id", u).collect()}
    assert one == many and all(0 <= x < 1 for x in one.values())
    assert one[3] == int(hashlib.md5(b"7:x:3").hexdigest()[:8], 16) / 2**32
    ints = {r.v for r in spark.range(500).select(int_draw(1, "i", 0, 3, F.col("id")).alias("v")).collect()}
    assert ints == {0, 1, 2, 3}


def test_weighted_buckets(spark):
    assert cut_points([0.15] * 6)[2] == pytest.approx(0.5)
    rows = spark.createDataFrame([(0.0,), (0.24,), (0.25,), (0.5,), (0.999,)], "u double")
    got = [r.b for r in rows.select(weighted_bucket(F.col("u"), [1, 1, 2]).alias("b")).collect()]
    assert got == [0, 0, 1, 2, 2]


def test_packed_words(spark):
    sets = [set(), {0, 63, 64, 127}, set(range(100)), {5, 63, 70}]
    rows = [(i, model.to_words(s, 2)) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "id int, words array<bigint>")
    long = {(r.id, r.bit) for r in bitwords.set_bits(df, 128).collect()}
    assert long == {(i, b) for i, s in enumerate(sets) for b in s}
    dense = {r.id: r.d for r in df.select("id", bitwords.dense(F.col("words"), 128).alias("d")).collect()}
    assert all(dense[i] == [int(b in s) for b in range(128)] for i, s in enumerate(sets))
    pairs = df.alias("x").join(df.alias("y"), F.col("x.id") <= F.col("y.id")).select(
        F.col("x.id").alias("i"), F.col("y.id").alias("j"), bitwords.dice(F.col("x.words"), F.col("y.words"), 2).alias("d")
    )
    for r in pairs.collect():
        assert r.d == model.dice(sets[r.i], sets[r.j])


def test_dense_computes_costly_words_once(spark):
    """Words that an expression gives are computed before the bits, not again for each of them."""
    costly = F.expr("transform(array(id, id + 1), x -> aggregate(sequence(1, 5), x, (a, i) -> a * 3 + i))")
    found = spark.range(4).select("id", costly.alias("words")).select("id", "words", bitwords.dense(F.col("words"), 100).alias("d"))
    slim = found.select("id", "d")
    assert str(slim._jdf.queryExecution().optimizedPlan()).count("Project [") == 2
    for r in found.collect():
        assert r.d == [(r.words[i // 64] >> (i % 64)) & 1 for i in range(100)]
