import math

import pytest
from pyspark.sql import functions as F

from veilink.operators import evaluate
from veilink.sources.sweep import LinkConfig

CONFIGS = [LinkConfig(1, m=100, k=2, hash="DoubleHash", encoding="CLK")]


def labelled(spark, rows, config=1):
    return spark.createDataFrame([(config, d, h) for d, h in rows], "config_id int, dice double, hit int")


def curve(rows):
    """Threshold, true and false rate of every distinct score, from the origin."""
    pos, neg = sum(h for _, h in rows), sum(1 - h for _, h in rows)
    points = [(math.inf, 0.0, 0.0)]
    for t in sorted({s for s, _ in rows}, reverse=True):
        points.append((t, sum(h for s, h in rows if s >= t) / pos, sum(1 - h for s, h in rows if s >= t) / neg))
    return points


ROWS = [(1.0, 1), (1.0, 1), (0.875, 1), (0.875, 0), (0.75, 0), (0.5, 1), (0.25, 0), (0.25, 0)]


def test_curve_area_and_threshold(spark):
    points = evaluate.roc_points(labelled(spark, ROWS))
    want = curve(ROWS)
    got = sorted(((r.threshold, r.tpr, r.fpr) for r in points.collect()), reverse=True)
    assert got == want
    area = sum((b[2] - a[2]) * (b[1] + a[1]) / 2 for a, b in zip(want, want[1:]))
    assert evaluate.roc_area(points).first().roc_area == pytest.approx(area)
    gains = [t - f for _, t, f in want]
    assert evaluate.best_threshold(points).first().threshold == want[gains.index(max(gains))][0]


def test_intermediate_points(spark):
    rows = [(1.0, 1), (0.75, 1), (0.5, 1), (0.25, 0)]
    kept = evaluate.roc_points(labelled(spark, rows), drop_intermediate=True)
    full = evaluate.roc_points(labelled(spark, rows))
    assert sorted(r.threshold for r in kept.collect()) == [0.25, 0.5, 1.0, math.inf]
    assert evaluate.roc_area(kept).first().roc_area == evaluate.roc_area(full).first().roc_area == 1.0


def test_only_hits_and_only_misses(spark):
    both = labelled(spark, [(1.0, 1), (0.5, 1)], 1).unionByName(labelled(spark, [(0.5, 0), (None, 0)], 2))
    summary = {r.config_id: r for r in evaluate.curve_summary(evaluate.roc_points(both)).collect()}
    assert summary[1].threshold == 0.5 and summary[1].roc_area == 1.0
    assert summary[2].threshold == math.inf and summary[2].roc_area is None
    rates = {r.config_id: r.hit_rate for r in evaluate.hit_rate(both).collect()}
    assert rates == {1: 1.0, 2: 0.0}


MATCH = (
    "config_id int, id bigint, truth bigint, error_type string, has_partner boolean, best_a bigint, dice double, "
    "candidates array<struct<id_a:bigint,dice:double,copies:bigint>>"
)


def verdict_frames(spark):
    rows = [
        (1, 1, 1, "Sem erro", True, 1, 1.0, [(1, 1.0, 1), (2, 0.4, 1), (3, 0.9, 1)]),
        (1, 2, 2, "Sem erro", True, 7, 0.8, [(7, 0.8, 3), (2, 0.3, 1)]),
        (1, 8, 8, "tipo 1", True, 7, 0.7, [(7, 0.7, 3)]),
        (1, 9, 9, "tipo 1", False, None, None, [(9, None, 2)]),
    ]
    matches = spark.createDataFrame(rows, MATCH)
    summary = spark.createDataFrame([(1, 0.5, 0.9)], "config_id int, threshold double, roc_area double")
    aliases = spark.createDataFrame([(1, 8, 7)], "config_id int, member bigint, id_a bigint")
    return matches, summary, aliases


def test_pair_verdicts(spark):
    matches, summary, aliases = verdict_frames(spark)
    found = {r.id: (r.VP, r.FP, r.VN, r.FN) for r in evaluate.pair_verdicts(matches, summary, aliases).collect()}
    # Record 8's partner is one of the three copies standing under 7; the null score of 9 is no miss.
    assert found == {1: (1, 1, 1, 0), 2: (0, 3, 0, 1), 8: (1, 2, 0, 0), 9: (0, 0, 2, 0)}


def test_float_threshold_equality(spark):
    value = 2.0 * 37 / 111
    matches = spark.createDataFrame([(1, 1, 1, "x", True, 1, value, [(1, value, 1)])], MATCH)
    points = evaluate.roc_points(evaluate.with_hit(matches))
    none = spark.createDataFrame([], "config_id int, member bigint, id_a bigint")
    found = evaluate.pair_verdicts(matches, evaluate.curve_summary(points), none).first()
    assert (found.VP, found.FN) == (1, 0)


def test_reports(spark):
    matches, summary, aliases = verdict_frames(spark)
    verdicts = evaluate.pair_verdicts(matches, summary, aliases)
    size_a = spark.createDataFrame([(1, 10)], "config_id int, size_a bigint")
    rows = {r.Tipo_erro: r for r in evaluate.report_by_error(verdicts, summary, size_a, CONFIGS).collect()}
    clean = rows["Sem erro"]
    assert (clean.VP, clean.FP, clean.VN, clean.FN, clean.tam_baseB) == (1, 4, 1, 1, 4)
    assert clean.pair_completeness == 0.5 and clean.precisao == pytest.approx(0.2)
    assert clean["reduction rate"] == pytest.approx(1 - 7 / 20)
    assert clean["pair quality"] == pytest.approx(1 / 7) and clean.acuracia == pytest.approx(2 / 7)
    assert clean["f-score"] == pytest.approx(2 * 0.2 * 0.5 / 0.7)
    by_partner = evaluate.report_by_error(verdicts, summary, size_a, CONFIGS, denominator="true_matches")
    assert {r.Tipo_erro: r.pair_completeness for r in by_partner.collect()}["tipo 1"] == 1.0
    assert tuple(by_partner.columns[1:]) == evaluate.ERROR_REPORT
    gold = evaluate.report_overall(verdicts, summary, size_a, CONFIGS)
    assert tuple(gold.columns[1:]) == evaluate.GOLD_REPORT
    row = gold.first()
    assert (row.VP, row.FP, row.VN, row.FN) == (2, 6, 3, 2)


def test_no_positive_gives_null_score(spark):
    sums = spark.createDataFrame([(0, 0, 5, 0, 10, 4)], "VP bigint, FP bigint, VN bigint, FN bigint, size_a bigint, registros bigint")
    row = evaluate.quality(sums, F.col("registros")).first()
    assert row.precisao == 0.0 and row["f-score"] is None and row.FN == 4
