"""Typed, repeatable error injection: one projection over the data, no branches and no unions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import damage
from ..functions.draws import int_draw, unit_draw, weighted_bucket
from ..sources.sweep import ErrorWeights

# Error labels, in group order.
ERROR_LABELS = ("Sem erro", "tipo 1", "tipo 2", "tipo 3", "tipo 4", "tipo 5")
CODE_NOISE = 10_000
DATE_NOISE = 365


@dataclass(frozen=True)
class Roles:
    """Which columns play the parts the injector damages."""

    key: str = "id"
    name: str = "name"
    guardian: str = "guardian"
    date: str = "birth_date"
    code: str = "city_code"

    @property
    def attributes(self) -> list[str]:
        return [self.name, self.guardian, self.date, self.code]


def error_group(roles: Roles, weights: ErrorWeights, seed: int) -> Column:
    """0 no error, 1 suppression, 2 word damage, 3 spelling, 4 category, 5 date."""
    return weighted_bucket(unit_draw(seed, "group", F.col(roles.key)), weights.groups)


def suppress_choice(roles: Roles, weights: ErrorWeights, seed: int) -> Column:
    """0 name, 1 guardian, 2 date, 3 code."""
    return weighted_bucket(unit_draw(seed, "suppress", F.col(roles.key)), weights.suppress)


def word_choice(roles: Roles, weights: ErrorWeights, seed: int) -> Column:
    """0/1 drop second word, 2/3 abbreviate first, 4/5 abbreviate second; even name, odd guardian."""
    return weighted_bucket(unit_draw(seed, "words", F.col(roles.key)), weights.words)


def code_noise(roles: Roles, seed: int) -> Column:
    return int_draw(seed, "code", 0, CODE_NOISE, F.col(roles.key))


def date_noise(roles: Roles, seed: int) -> Column:
    return int_draw(seed, "date", 0, DATE_NOISE, F.col(roles.key))


def with_buckets(people: DataFrame, weights: ErrorWeights, seed: int, roles: Roles = Roles()) -> DataFrame:
    """Adds ``error_group``, ``suppress_choice`` and ``word_choice``."""
    return people.withColumns(
        {
            "error_group": error_group(roles, weights, seed),
            "suppress_choice": suppress_choice(roles, weights, seed),
            "word_choice": word_choice(roles, weights, seed),
        }
    )


def inject_errors(
    people: DataFrame,
    weights: ErrorWeights,
    seed: int,
    roles: Roles = Roles(),
    abbreviation: str = "literal",
    label: str = "error_type",
) -> DataFrame:
    """Damage every row according to its group; ``label`` becomes the last column."""
    group, sup, word = F.col("error_group"), F.col("suppress_choice"), F.col("word_choice")

    def name_like(column: str, position: int) -> Column:
        z = F.col(column)
        return (
            F.when((group == 1) & (sup == position), damage.suppressed())
            .when((group == 2) & (word == position), damage.drop_second_word(z))
            .when((group == 2) & (word == 2 + position), damage.abbreviate_first(z, abbreviation))
            .when((group == 2) & (word == 4 + position), damage.abbreviate_second(z))
            .when(group == 3, damage.spelling_variant(z))
            .otherwise(z)
        )

    date, code = F.col(roles.date).cast("string"), F.col(roles.code).cast("string")
    damaged = {
        roles.name: name_like(roles.name, 0),
        roles.guardian: name_like(roles.guardian, 1),
        roles.date: F.when((group == 1) & (sup == 2), damage.suppressed())
        .when(group == 5, damage.shift_date(date, date_noise(roles, seed)))
        .otherwise(date),
        roles.code: F.when((group == 1) & (sup == 3), damage.suppressed())
        .when(group == 4, damage.shift_code(code, code_noise(roles, seed)))
        .otherwise(code),
        label: F.element_at(F.array(*[F.lit(x) for x in ERROR_LABELS]), group + 1),
    }
    bucketed = with_buckets(people, weights, seed, roles)
    return bucketed.withColumns(damaged).drop("error_group", "suppress_choice", "word_choice")


def append_unpartnered(shared: DataFrame, extra: DataFrame) -> DataFrame:
    """B's records: those that A holds too, then those without a partner, told apart by ``has_partner``."""
    return shared.withColumn("has_partner", F.lit(True)).unionByName(extra.withColumn("has_partner", F.lit(False)))


def error_types(b: DataFrame, label: str = "error_type") -> DataFrame:
    """Distinct labels in order."""
    return b.select(label).distinct().orderBy(label)
