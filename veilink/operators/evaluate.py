"""Linkage quality: hit labels, ROC, threshold, pair verdicts and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.sweep import LinkConfig


def with_hit(matches: DataFrame, truth: str = "truth") -> DataFrame:
    """1 where the best candidate is the true partner, else 0 (also when there is no best)."""
    return matches.withColumn("hit", F.coalesce((F.col("best_a") == F.col(truth)).cast("int"), F.lit(0)))


def hit_rate(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("config_id").agg(F.avg("hit").alias("hit_rate"))


def score_counts(labelled: DataFrame) -> DataFrame:
    """Hits and misses per distinct score, (config_id, score, pos, neg).

    A score is a ratio of two bit counts, so the number of distinct scores is bounded by the square of the
    filter length whatever the data; later windows run on these few rows.  No best counts as score 0.  If
    every record is a hit, one miss with score 0 is added so that a curve exists.
    """
    score = F.coalesce(F.col("dice").cast("float"), F.lit(0.0).cast("float")).alias("score")
    counts = labelled.groupBy("config_id", score).agg(
        F.sum("hit").cast("bigint").alias("pos"), F.sum(1 - F.col("hit")).cast("bigint").alias("neg")
    )
    all_hits = counts.groupBy("config_id").agg(F.sum("neg").alias("misses")).where(F.col("misses") == 0)
    extra = all_hits.select(
        "config_id",
        F.lit(0.0).cast("float").alias("score"),
        F.lit(0).cast("bigint").alias("pos"),
        F.lit(1).cast("bigint").alias("neg"),
    )
    both = counts.unionByName(extra)
    return both.groupBy("config_id", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def roc_points(labelled: DataFrame, drop_intermediate: bool = False) -> DataFrame:
    """(config_id, threshold, tpr, fpr) by falling threshold, from the origin at +infinity.

    ``drop_intermediate`` leaves out points whose steps equal those of both neighbours.
    """
    counts = score_counts(labelled)
    falling = W.partitionBy("config_id").orderBy(F.desc("score"))
    upto = falling.rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy("config_id")
    curve = counts.select(
        "config_id",
        F.col("score").cast("double").alias("threshold"),
        F.sum("pos").over(upto).alias("tp"),
        F.sum("neg").over(upto).alias("fp"),
        F.sum("pos").over(whole).alias("all_pos"),
        F.sum("neg").over(whole).alias("all_neg"),
    )
    if drop_intermediate:
        by_threshold = W.partitionBy("config_id").orderBy(F.desc("threshold"))

        def bend(c: str) -> Column:
            after, before = F.lead(c).over(by_threshold), F.lag(c).over(by_threshold)
            return F.coalesce((after - F.col(c)) != (F.col(c) - before), F.lit(True))

        curve = curve.withColumn("corner", bend("tp") | bend("fp")).where("corner").drop("corner")
    rates = curve.select(
        "config_id",
        "threshold",
        F.try_divide(F.col("tp"), F.col("all_pos")).alias("tpr"),
        F.try_divide(F.col("fp"), F.col("all_neg")).alias("fpr"),
    )
    origin = counts.groupBy("config_id").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q")).select(
        "config_id",
        F.lit(float("inf")).alias("threshold"),
        F.try_divide(F.lit(0.0), F.col("p")).alias("tpr"),
        F.try_divide(F.lit(0.0), F.col("q")).alias("fpr"),
    )
    return rates.unionByName(origin)


def roc_area(points: DataFrame) -> DataFrame:
    """Trapezoid area under the curve: (config_id, roc_area)."""
    falling = W.partitionBy("config_id").orderBy(F.desc("threshold"))
    step = (F.col("fpr") - F.lag("fpr").over(falling)) * (F.col("tpr") + F.lag("tpr").over(falling)) / 2
    return points.withColumn("step", step).groupBy("config_id").agg(F.sum("step").alias("roc_area"))


def best_threshold(points: DataFrame) -> DataFrame:
    """Threshold of the largest tpr - fpr, the highest on ties: (config_id, threshold)."""
    gain = F.struct((F.col("tpr") - F.col("fpr")).alias("j"), "threshold")
    chosen = points.groupBy("config_id").agg(F.max_by("threshold", gain).alias("threshold"))
    return chosen.select("config_id", F.coalesce("threshold", F.lit(float("inf"))).alias("threshold"))


def curve_summary(points: DataFrame) -> DataFrame:
    """(config_id, threshold, roc_area): one row per configuration."""
    return best_threshold(points).join(roc_area(points), "config_id")


def pair_verdicts(matches: DataFrame, summary: DataFrame, aliases: DataFrame | None = None, truth: str = "truth") -> DataFrame:
    """Counts of a B record's candidate pairs: adds VP, FP, VN and FN.

    Candidates come per distinct filter with a copy count; one of the copies, at most, counts as the true partner.
    A true partner that is represented by another id is found through ``aliases`` (config_id, member, id_a; None if every
    record represents itself); where several records of A share the true id, the most similar of them in the leaf is the
    partner.  Scores are compared as 32-bit floats; a null score is never at or above the threshold and never a miss.

    Only B records whose true id is a member of some alias take part in the look-up.  Their candidates are met with the
    aliases by (true id, candidate), so an id that a large part of A shares is spread over its representatives.
    """
    unknown = F.lit(None).cast("double").alias("_alias_dice")
    if aliases is None:
        return _verdicts(matches.select("*", unknown), summary, truth)
    known = aliases.select("config_id", F.col("member").alias(truth), "id_a").distinct()
    members = known.select("config_id", truth).distinct()
    plain = matches.join(members, ["config_id", truth], "left_anti").select("*", unknown)
    numbered = matches.withColumn("_row", F.monotonically_increasing_id())
    shared = numbered.join(members, ["config_id", truth], "left_semi")
    each = shared.select("*", F.explode_outer("candidates").alias("_c")).withColumn("id_a", F.col("_c.id_a"))
    met = each.join(known.withColumn("_alias", F.lit(True)), ["config_id", truth, "id_a"], "left")
    met = met.select("_row", *matches.columns, F.when(F.col("_alias"), F.col("_c.dice")).alias("_score"))
    again = met.groupBy("_row").agg(*[F.first(c).alias(c) for c in matches.columns], F.max("_score").alias("_alias_dice"))
    return _verdicts(plain.unionByName(again.drop("_row")), summary, truth)


def _verdicts(known: DataFrame, summary: DataFrame, truth: str) -> DataFrame:
    """``known`` are matches with the best Dice of the true partner's representatives, ``_alias_dice``."""
    known = known.join(F.broadcast(summary), "config_id")
    above = F.coalesce(F.col("_dice_f") >= F.col("threshold"), F.lit(False))
    zero = F.lit(0).cast("bigint")

    def count(keep) -> Column:
        return F.aggregate("candidates", zero, lambda acc, c: acc + F.when(keep(c), c["copies"]).otherwise(zero))

    def at_or_above(c: Column) -> Column:
        return F.coalesce(c["dice"].cast("float").cast("double") >= F.col("threshold"), F.lit(False))

    own = F.array_max(F.transform(F.filter("candidates", lambda c: c["id_a"] == F.col(truth)), lambda c: c["dice"]))
    with_partner = known.withColumn("_dice_f", F.greatest(own, "_alias_dice").cast("float").cast("double"))
    counted = with_partner.withColumns(
        {
            "_total": count(lambda c: F.lit(True)),
            "_high": count(at_or_above),
            "VP": above.cast("bigint"),
            "FN": F.coalesce(F.col("_dice_f") < F.col("threshold"), F.lit(False)).cast("bigint"),
        }
    )
    verdicts = counted.withColumns(
        {"FP": F.col("_high") - F.col("VP"), "VN": F.col("_total") - F.col("_high") - F.col("FN")}
    )
    return verdicts.drop("_alias_dice", "_dice_f", "_total", "_high")


def _f(column: Column) -> Column:
    return column.cast("float")


def quality(sums: DataFrame, denominator: Column) -> DataFrame:
    """Ratios from VP, FP, VN, |A| (``size_a``) and |B| (``registros``); FN becomes the missed matches."""
    vp, fp, vn, fn = (F.col(c) for c in ("VP", "FP", "VN", "FN"))
    pairs = (vp + vn + fp + fn).cast("double")
    rated = sums.withColumn("FN", F.col("registros") - F.col("VP")).withColumns(
        {
            "pair_completeness": _f(F.try_divide(vp.cast("double"), denominator.cast("double"))),
            "reduction rate": _f(
                F.lit(1.0)
                - F.try_divide(pairs, F.col("size_a").cast("double") * F.col("registros").cast("double"))
            ),
            "pair quality": _f(F.try_divide(vp.cast("double"), pairs)),
            "acuracia": _f(F.try_divide((vp + vn).cast("double"), pairs)),
            "precisao": _f(F.when(vp == 0, F.lit(0.0)).otherwise(vp / (vp + fp))),
        }
    )
    p, r = F.col("precisao").cast("double"), F.col("pair_completeness").cast("double")
    return rated.withColumn("f-score", _f(F.try_divide(F.lit(2.0) * p * r, p + r)))


def config_facts(configs: Sequence[LinkConfig]) -> Column:
    """Run metadata as a literal map from configuration to struct."""
    entries = []
    for c in configs:
        entries += [
            F.lit(c.config_id),
            F.struct(
                F.lit(c.m).alias("tamanho_BF"),
                F.lit(c.k).alias("quant_hash"),
                F.lit(c.hash).alias("tipo_hash"),
                F.lit(c.encoding).alias("tipo_BF"),
                F.lit(c.weights.error_share).alias("porcentagem_erro"),
                F.lit(c.rlb_slots / c.m).alias("porcentagem_rlb"),
            ),
        ]
    return F.create_map(*entries)


# Column order of the reports (the run time is left to the bench).
ERROR_REPORT = (
    "VP", "FP", "VN", "FN", "tamanho_BF", "quant_hash", "tipo_hash", "tipo_BF", "porcentagem_erro",
    "porcentagem_rlb", "threshold", "roc_area", "pair_completeness", "reduction rate", "pair quality",
    "acuracia", "precisao", "f-score", "Tipo_erro", "tam_baseB",
)
GOLD_REPORT = (
    "VP", "FP", "VN", "FN", "tamanho_BF", "quant_hash", "tipo_hash", "tipo_BF", "porcentagem_rlb",
    "threshold", "roc_area", "pair_completeness", "reduction rate", "pair quality", "acuracia", "precisao",
    "f-score",
)


def _sums(verdicts: DataFrame, by: list[str], partnered: bool) -> DataFrame:
    extra = [F.count_if(F.col("has_partner")).alias("true_matches")] if partnered else []
    return verdicts.groupBy("config_id", *by).agg(
        *[F.sum(c).alias(c) for c in ("VP", "FP", "VN", "FN")], F.count(F.lit(1)).alias("registros"), *extra
    )


def report_by_error(
    verdicts: DataFrame,
    summary: DataFrame,
    size_a: DataFrame,
    configs: Sequence[LinkConfig],
    label: str = "error_type",
    denominator: str = "rows",
) -> DataFrame:
    """One row per configuration and error type, all types in one aggregation.

    ``denominator='rows'`` counts records without a partner as missed; ``'true_matches'`` leaves them out
    of recall by ``has_partner``.  ``size_a`` is (config_id, size_a), one row per configuration.
    """
    sums = _sums(verdicts, [label], "has_partner" in verdicts.columns)
    size_b = sums.groupBy("config_id").agg(F.sum("registros").alias("tam_baseB"))
    facts = sums.join(F.broadcast(summary), "config_id").join(F.broadcast(size_a), "config_id")
    facts = facts.join(F.broadcast(size_b), "config_id")
    if denominator not in ("rows", "true_matches"):
        raise ValueError(f"unknown denominator {denominator!r}")
    base = F.col("registros" if denominator == "rows" else denominator)
    rated = quality(facts, base).withColumn("c", F.element_at(config_facts(configs), F.col("config_id")))
    return rated.select("*", "c.*").withColumnRenamed(label, "Tipo_erro").select("config_id", *ERROR_REPORT)


def report_overall(verdicts: DataFrame, summary: DataFrame, size_a: DataFrame, configs: Sequence[LinkConfig]) -> DataFrame:
    """One row per configuration over all of B (gold data)."""
    sums = _sums(verdicts, [], False)
    facts = sums.join(F.broadcast(summary), "config_id").join(F.broadcast(size_a), "config_id")
    rated = quality(facts, F.col("registros")).withColumn("c", F.element_at(config_facts(configs), F.col("config_id")))
    return rated.select("*", "c.*").select("config_id", *GOLD_REPORT)
