"""Linkage runs: corrupt, encode, index, search, evaluate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import evaluate, match
from ..operators.corrupt import Roles, inject_errors
from ..operators.distinct import DistinctFilters, distinct_filters, last_per_id
from ..operators.encode import codebook, encode, with_configs
from ..operators.match import search_all, search_tree
from ..operators.tree import Tree, build_tree
from ..sources.store import Stored, store
from ..sources.sweep import LinkConfig, widest


@dataclass(frozen=True)
class Encoded:
    """Filters of both sides; A is grouped by equal filters."""

    a: Stored
    distinct: DistinctFilters
    b: DataFrame
    size: int

    def index(self, **options) -> Tree:
        return build_tree(self.distinct, self.size, **options)


def _damaged(people: DataFrame, configs: Sequence[LinkConfig], roles: Roles) -> list[tuple[DataFrame, list[int]]]:
    """A damaged copy of B per setting of errors, with the configurations that share it."""
    plans: dict = {}
    for c in configs:
        plans.setdefault((c.weights, c.seed), []).append(c.config_id)
    return [(inject_errors(people, weights, seed, roles), numbers) for (weights, seed), numbers in plans.items()]


def corrupted_b(people: DataFrame, configs: Sequence[LinkConfig], roles: Roles = Roles()) -> DataFrame:
    """B per configuration.  Configurations with the same error weights share one damaged copy."""
    parts = [
        damaged.withColumn("config_id", F.explode(F.array(*[F.lit(n) for n in numbers])))
        for damaged, numbers in _damaged(people, configs, roles)
    ]
    return reduce(DataFrame.unionByName, parts)


def encode_sides(
    a: DataFrame,
    b: DataFrame,
    columns_a: list[str],
    columns_b: list[str],
    configs: Sequence[LinkConfig],
    keep_b: list[str],
    hash_mode: str = "literal",
    last_of_id: bool = False,
    texts_b: DataFrame | None = None,
) -> Encoded:
    """``a`` needs ``id`` (and ``ord`` if the order of A is not that of its ids), of any type with an order.

    ``texts_b`` holds B's values once, where ``b`` repeats them by configuration: bigrams are gathered from it.
    Records of A whose ids repeat all stand, unless ``last_of_id`` keeps the last one, by ``ord``, of each id.
    """
    if last_of_id and "ord" not in a.columns:
        raise ValueError("the last record of an id is told by the column ord")
    configs = [c.with_attrs(len(columns_a)) for c in configs]
    book = codebook([a, b if texts_b is None else texts_b], [columns_a, columns_b], configs, hash_mode)
    keep_a = ["id"] + (["ord"] if "ord" in a.columns else [])
    filters_a = encode(a, columns_a, configs, book, keep_a)
    stored_a = store(last_per_id(filters_a) if last_of_id else filters_a, "encoded-a")
    encoded_b = encode(b, columns_b, configs, book, keep_b)
    return Encoded(stored_a, distinct_filters(stored_a.frame), encoded_b, widest(configs))


def shared_index(configs: Sequence[LinkConfig]) -> dict[int, int]:
    """Configuration -> the first one with the same encoding; they differ in their errors only.

    A is encoded and indexed once per encoding, whatever the number of error settings.
    """
    first: dict = {}
    return {c.config_id: first.setdefault(replace(c, config_id=0, weights=None), c.config_id) for c in configs}


def sizes_of(encoded: DataFrame, name: str) -> DataFrame:
    return encoded.groupBy("config_id").agg(F.count(F.lit(1)).alias(name))


@dataclass(frozen=True)
class Links:
    """Search result with everything the reports need; ``matches`` is written, so reports do not search again.

    ``index_of`` names the configuration under which A was indexed, for each of ``configs``.
    """

    matches: DataFrame
    encoded: Encoded
    configs: Sequence[LinkConfig]
    index_of: dict[int, int]

    def _per_run(self, indexed: DataFrame) -> DataFrame:
        """Rows keyed by index configuration, repeated for the configurations that share it."""
        runs: dict = {}
        for run, index in self.index_of.items():
            runs.setdefault(index, []).append(run)
        if all(group == [index] for index, group in runs.items()):
            return indexed
        table = ", ".join(f"{index}, array({', '.join(map(str, group))})" for index, group in runs.items())
        return indexed.withColumn("config_id", F.expr(f"explode(element_at(map({table}), config_id))"))

    def summary(self) -> DataFrame:
        return evaluate.curve_summary(evaluate.roc_points(self.matches))

    def verdicts(self, summary: DataFrame | None = None) -> DataFrame:
        distinct = self.encoded.distinct
        aliases = self._per_run(distinct.aliases()) if distinct.has_copies else None
        return evaluate.pair_verdicts(self.matches, self.summary() if summary is None else summary, aliases)

    def candidate_pairs(self, keep: list[str]) -> DataFrame:
        """All candidate records of A for every B record, copies included: (config_id, keep..., id_a, dice)."""
        return match.candidate_pairs(self.matches, self._per_run(self.encoded.distinct.aliases()), keep)

    def candidate_maps(self, keep: list[str], **options) -> DataFrame:
        """Best link and a map of all candidate records for every B record: (config_id, keep..., part, parts, busca)."""
        return match.candidate_maps(self.matches, self._per_run(self.encoded.distinct.members()), keep, **options)

    def size_a(self) -> DataFrame:
        return self._per_run(sizes_of(self.encoded.a.frame, "size_a"))

    def report_by_error(self, denominator: str = "rows") -> DataFrame:
        summary = store(self.summary(), "summary").frame
        return evaluate.report_by_error(
            self.verdicts(summary), summary, self.size_a(), self.configs, denominator=denominator
        )

    def report_overall(self) -> DataFrame:
        summary = store(self.summary(), "summary").frame
        return evaluate.report_overall(self.verdicts(summary), summary, self.size_a(), self.configs)


def _links(
    a: DataFrame, b: DataFrame, columns: list[str], configs: Sequence[LinkConfig], keep: list[str], options: dict, texts_b: DataFrame
) -> Links:
    """``b`` carries ``config_id`` where it differs by configuration; it is searched under the shared index."""
    index_of = shared_index(configs)
    indexed = [c for c in configs if index_of[c.config_id] == c.config_id]
    runs = with_configs(b, configs)
    table = ", ".join(f"{run}, {index}" for run, index in index_of.items())
    runs = runs.withColumn("run_id", F.col("config_id")).withColumn("config_id", F.expr(f"map({table})[config_id]"))
    encoded = encode_sides(a, runs, columns, columns, indexed, ["run_id"] + keep, last_of_id=options["last_of_id"], texts_b=texts_b)
    tree = encoded.index(subtree_rows=options["subtree_rows"], min_levels=options["min_levels"])
    found = search_tree(tree, encoded.b, ["run_id"] + keep)
    matches = found.drop("config_id").withColumnRenamed("run_id", "config_id")
    return Links(store(evaluate.with_hit(matches), "matches").frame, encoded, configs, index_of)


def _options(last_of_id: bool, subtree_rows: int | None, min_levels: int) -> dict:
    return {"last_of_id": last_of_id, "subtree_rows": subtree_rows, "min_levels": min_levels}


def link_synthetic(
    a: DataFrame,
    b_clean: DataFrame,
    configs: Sequence[LinkConfig],
    roles: Roles = Roles(),
    last_of_id: bool = False,
    subtree_rows: int | None = None,
    min_levels: int = 3,
) -> Links:
    """A against a damaged copy of B; a record's true partner has the same id.

    Both tables name their columns by ``roles``; the result has the key as ``id``.
    """
    b = corrupted_b(b_clean, configs, roles).withColumnRenamed(roles.key, "id").withColumn("truth", F.col("id"))
    keep = ["id", "truth", "error_type"] + (["has_partner"] if "has_partner" in b_clean.columns else [])
    a = a.withColumnRenamed(roles.key, "id")
    once = reduce(DataFrame.unionByName, [damaged.select(*roles.attributes) for damaged, _ in _damaged(b_clean, configs, roles)])
    return _links(a, b, roles.attributes, configs, keep, _options(last_of_id, subtree_rows, min_levels), once)


def link_gold(
    a: DataFrame,
    b: DataFrame,
    columns: list[str],
    configs: Sequence[LinkConfig],
    check: str = "check",
    key: str = "id",
    last_of_id: bool = False,
    subtree_rows: int | None = None,
    min_levels: int = 3,
) -> Links:
    """A against B with a gold column naming the true partner; nothing is damaged."""
    a, b = (side.withColumnRenamed(key, "id") for side in (a, b))
    b = b.withColumn("truth", F.col(check))
    return _links(a, b, columns, configs, ["id", "truth"], _options(last_of_id, subtree_rows, min_levels), b)


def link_exhaustive(a: DataFrame, b: DataFrame, columns: list[str], configs: Sequence[LinkConfig], keep: list[str]) -> DataFrame:
    """Best partner over all of A, without an index."""
    encoded = encode_sides(a, b, columns, columns, configs, keep)
    return evaluate.with_hit(search_all(encoded.distinct, encoded.b, keep))
