"""The registered queries: each takes (spark, sf_dir) and runs over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import bitwords, damage
from ..functions.draws import unit_draw, weighted_bucket
from ..functions.hashing import DOUBLE, ENHANCED, TRIPLE
from ..functions.text import with_tokens
from ..operators import evaluate
from ..operators.corrupt import Roles, append_unpartnered, code_noise, date_noise, error_types, inject_errors, with_buckets
from ..operators.distinct import distinct_filters
from ..operators.encode import block_filter, codebook, encode, token_positions
from ..operators.match import candidate_map, candidates_long
from ..operators.rows import rows_between, zip_rows
from ..operators.sampling import strata, stratified_sample
from ..operators.synth import with_synthetic_date
from ..operators.tree import build_tree, leaf_members, splits_of
from ..sources.store import fresh_path, store
from ..sources.sweep import ABF, CLK, RLB, ErrorWeights, LinkConfig, append_configs, grid, read_configs, sizes, to_configs
from ..sources.tables import append_results, normalise_columns, read_delimited, read_folder, read_table, write_base
from . import linkage
from .base_builder import BASE_SEED, FRACTION, GUARDIAN_SEED, synthetic_base, with_city_code
from .people import GOLD_COLUMNS, exchanged, gold_sides, people_of, side_a, side_b, with_copies, with_repeated_ids

ROLES = Roles()
ATTRS = ROLES.attributes
SEED = 1991
WEIGHTS = ErrorWeights.evenly(0.05)
MAIN = LinkConfig(1, m=100, k=2, hash=DOUBLE, encoding=CLK, weights=WEIGHTS, seed=SEED)
ABF_RUN = LinkConfig(1, m=100, k=2, hash=DOUBLE, encoding=ABF, weights=WEIGHTS, seed=SEED)
RLB_RUN = LinkConfig(1, m=100, k=2, hash=DOUBLE, encoding=RLB, rlb_share=0.4, weights=WEIGHTS, seed=SEED)
GOLD = LinkConfig(1, m=200, k=20, hash=DOUBLE, encoding=ABF, n_attrs=5, seed=SEED)
SWEEP = [
    LinkConfig(1, m=100, k=2, hash=DOUBLE, encoding=ABF, weights=WEIGHTS, seed=SEED),
    LinkConfig(2, m=100, k=2, hash=DOUBLE, encoding=CLK, weights=ErrorWeights.evenly(0.02), seed=SEED),
    LinkConfig(3, m=100, k=2, hash=DOUBLE, encoding=RLB, rlb_share=0.4, weights=ErrorWeights.evenly(0.1), seed=SEED),
]
SLICE = (100, 400)
Query = Callable[[SparkSession, str], DataFrame]


def people_base(spark: SparkSession, sf: str) -> DataFrame:
    people = people_of(spark, sf).withColumn("code", F.col("city_code").cast("int"))
    return people.dropna(subset=["birth_date"])


def _register(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    register = people_of(spark, sf).select(
        "id", F.col("state").alias("UF"), F.col("name").alias("NOME"), F.col("state").alias("MUNICIPIO")
    )
    # Some cities go by another name, so that the left join has rows without a match.
    name = F.when(F.col("n_nationkey") < 20, F.lower("n_name")).otherwise(F.concat(F.lit("nova "), F.lower("n_name")))
    cities = read_table(spark, f"{sf}/nation.parquet").select(
        name.alias("cidade"), (F.lit(1000) + F.col("n_nationkey")).alias("COD_MUNICIPIO")
    )
    return register, normalise_columns(cities, {"cidade": "MUNICIPIO"})


def register_join(spark: SparkSession, sf: str) -> DataFrame:
    register, cities = _register(spark, sf)
    joined = with_city_code(register, cities)
    return joined.select("id", "UF", "NOME", "MUNICIPIO", F.col("COD_MUNICIPIO").alias("code"))


def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    people = people_of(spark, sf)
    path = fresh_path(spark, "base-csv")
    write_base(people, path)
    return read_delimited(spark, path, schema=people.schema)


def slice_rows(spark: SparkSession, sf: str) -> DataFrame:
    people = people_of(spark, sf)
    return rows_between(people, *SLICE, order=["id"]).select("id", "name", "guardian")


def _share_counts(people: DataFrame, by_type: bool) -> DataFrame:
    """Records per error share, split by error group or counted where damaged, in one pass."""
    draw = unit_draw(SEED, "group", F.col("id"))
    groups = [
        F.struct(
            F.lit(percent).alias("percent"),
            weighted_bucket(F.col("u"), ErrorWeights.evenly(percent / 100).groups).alias("error_group"),
        )
        for percent in (2, 5, 10)
    ]
    drawn = people.select(draw.alias("u")).select(F.inline(F.array(*groups)))
    rows = drawn if by_type else drawn.where(F.col("error_group") > 0)
    keys = ["percent", "error_group"] if by_type else ["percent"]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"))


def config_grid(spark: SparkSession, sf: str) -> DataFrame:
    counts = _share_counts(people_of(spark, sf).select("id"), by_type=True)
    cells = sizes(grid(spark), n_attrs=4).withColumn("percent", F.round(F.col("error_share") * 20).cast("int"))
    return cells.join(F.broadcast(counts), "percent").select(
        "config_id", "m", "size", "encoding", "error_share", "error_group", "records"
    )


def config_parse(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "sweep")
    append_configs(grid(spark), path)
    parsed = sizes(read_configs(spark, path, lines=True), n_attrs=4)
    counts = _share_counts(people_of(spark, sf).select("id"), by_type=False)
    keyed = parsed.withColumn("percent", F.round(F.col("error_share") * 20).cast("int"))
    return keyed.join(F.broadcast(counts), "percent").select(
        "config_id", "m", "size", "k", "hash", "encoding", "rlb_share", "error_share", F.col("records").alias("damaged")
    )


def stratified(spark: SparkSession, sf: str) -> DataFrame:
    people = people_of(spark, sf)
    fractions = strata(people, "state", FRACTION)
    first = stratified_sample(people, "state", fractions, "id", BASE_SEED)
    second = stratified_sample(people, "state", FRACTION, "id", GUARDIAN_SEED)
    columns = ["id", "state", "name"]
    return first.select(F.lit(1).alias("sample"), *columns).unionByName(second.select(F.lit(2).alias("sample"), *columns))


def error_buckets(spark: SparkSession, sf: str) -> DataFrame:
    bucketed = with_buckets(people_of(spark, sf), WEIGHTS, SEED)
    return bucketed.groupBy("error_group", "suppress_choice", "word_choice").agg(F.count(F.lit(1)).alias("records"))


def _damage(name: str, damaged: Callable[[], dict[str, Column]]) -> tuple[str, Query]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        people = people_of(spark, sf)
        return people.select("id", *[c.alias(n) for n, c in damaged().items()])

    return name, run


def _both(rule: Callable[[Column], Column]) -> Callable[[], dict[str, Column]]:
    return lambda: {"name": rule(F.col("name")), "guardian": rule(F.col("guardian"))}


DAMAGE_QUERIES = dict(
    [
        _damage("corrupt_suppress", _both(lambda z: damage.suppressed())),
        _damage("corrupt_drop_word", _both(damage.drop_second_word)),
        _damage("corrupt_abbrev_first", _both(damage.abbreviate_first)),
        _damage("corrupt_abbrev_second", _both(damage.abbreviate_second)),
        _damage("corrupt_spelling", _both(damage.spelling_variant)),
        _damage(
            "corrupt_code", lambda: {"city_code": damage.shift_code(F.col("city_code"), code_noise(ROLES, SEED))}
        ),
        _damage(
            "corrupt_date", lambda: {"birth_date": damage.shift_date(F.col("birth_date"), date_noise(ROLES, SEED))}
        ),
    ]
)


def corrupt_all(spark: SparkSession, sf: str) -> DataFrame:
    people = people_of(spark, sf)
    shared = side_a(people)
    extra = people.where(F.col("id") % 20 == 19)
    return inject_errors(append_unpartnered(shared, extra), WEIGHTS, SEED)


def error_type_list(spark: SparkSession, sf: str) -> DataFrame:
    return error_types(inject_errors(people_of(spark, sf), WEIGHTS, SEED))


def bigrams(spark: SparkSession, sf: str) -> DataFrame:
    tokens = with_tokens(people_of(spark, sf).select("id", *ATTRS), ATTRS).where(F.col("token").isNotNull())
    return tokens.groupBy("id", "attr_idx", "token").agg(F.count(F.lit(1)).alias("times"))


def _hash_query(family: str, k: int) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        people = people_of(spark, sf)
        tokens = with_tokens(people.select(*ATTRS), ATTRS).where(F.col("token").isNotNull())
        uses = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
        config = LinkConfig(1, m=100, k=k, hash=family, encoding=ABF, n_attrs=4)
        placed = token_positions(uses.select("token", F.lit(0).alias("attr_idx")), [config])
        return placed.join(uses, "token").select("token", "round", "pos", "uses")

    return run


def _filters(spark: SparkSession, sf: str, config: LinkConfig) -> DataFrame:
    people = stored_people(spark, sf)
    book = codebook([people], [ATTRS], [config])
    return encode(people, ATTRS, [config], book, ["id"])


def _encode_query(config: LinkConfig) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return bitwords.set_bits(_filters(spark, sf, config), config.size).select("id", "bit")

    return run


def encode_block30(spark: SparkSession, sf: str) -> DataFrame:
    return block_filter(people_of(spark, sf), "name")


def dense_filter(spark: SparkSession, sf: str) -> DataFrame:
    filters = _filters(spark, sf, MAIN)
    return filters.select("id", F.array_join(bitwords.dense(F.col("words"), MAIN.size), "").alias("filter"))


def stored_people(spark: SparkSession, sf: str) -> DataFrame:
    """People written once for plans that read them several times, spread over the shuffle partitions."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return store(people_of(spark, sf).repartition(parts, "id"), "people").frame


def _tree(spark: SparkSession, sf: str, **options):
    a = side_a(stored_people(spark, sf))
    encoded = store(encode(a, ATTRS, [MAIN], codebook([a], [ATTRS], [MAIN]), ["id"]), "encoded-a").frame
    distinct = distinct_filters(encoded)
    return build_tree(distinct, MAIN.size, **options), distinct


def _first_splits(levels: int) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        tree, _ = _tree(spark, sf, max_levels=levels)
        found = None
        for level in tree.levels:
            rows = level.frame.select("node_path", "bit", F.col("n").alias("records"), F.col("ones").alias("with_bit"))
            found = rows if found is None else found.unionByName(rows)
        return found

    return run


def tree_leaves(spark: SparkSession, sf: str) -> DataFrame:
    return leaf_members(*_tree(spark, sf)).select("id", "node_path")


def tree_splits(spark: SparkSession, sf: str) -> DataFrame:
    tree, _ = _tree(spark, sf)
    return splits_of(tree).select("node_path", "bit")


def _synthetic_links(spark: SparkSession, sf: str) -> linkage.Links:
    people = stored_people(spark, sf)
    return linkage.link_synthetic(side_a(people), side_b(people), [MAIN])


def link_tree(spark: SparkSession, sf: str) -> DataFrame:
    return _synthetic_links(spark, sf).matches.select("id", "error_type", "best_a", F.round("dice", 6).alias("dice"), "hit")


def link_exhaustive(spark: SparkSession, sf: str) -> DataFrame:
    people = stored_people(spark, sf)
    b = linkage.corrupted_b(side_b(people), [MAIN]).withColumn("truth", F.col("id"))
    found = linkage.link_exhaustive(side_a(people), b, ATTRS, [MAIN], ["id", "truth", "error_type"])
    return found.select("id", "error_type", "best_a", F.round("dice", 6).alias("dice"), "hit")


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    matches = _synthetic_links(spark, sf).matches
    mapped = candidate_map(matches, ["id"]).select("id", F.explode("busca.pares_candidatos").alias("id_a", "value"))
    copies = candidates_long(matches, ["id"]).select("id", "id_a", "copies")
    return mapped.join(copies, ["id", "id_a"]).select(
        "id", "id_a", F.round(F.col("value").cast("double"), 6).alias("dice"), "copies"
    )


def roc_points(spark: SparkSession, sf: str) -> DataFrame:
    points = evaluate.roc_points(_synthetic_links(spark, sf).matches)
    return points.select(*[F.round(c, 6).alias(c) for c in ("threshold", "tpr", "fpr")])


def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    points = evaluate.roc_points(_synthetic_links(spark, sf).matches)
    return evaluate.roc_area(points).select(F.round("roc_area", 6).alias("roc_area"))


def youden_threshold(spark: SparkSession, sf: str) -> DataFrame:
    points = evaluate.roc_points(_synthetic_links(spark, sf).matches)
    return evaluate.best_threshold(points).select(F.round("threshold", 6).alias("threshold"))


def hit_rate(spark: SparkSession, sf: str) -> DataFrame:
    rate = evaluate.hit_rate(_synthetic_links(spark, sf).matches)
    return rate.select(F.round("hit_rate", 6).alias("hit_rate"))


def pair_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return _synthetic_links(spark, sf).verdicts().select("id", "VP", "FP", "VN", "FN")


def _rounded(report: DataFrame) -> DataFrame:
    real = [c for c, t in report.dtypes if t in ("float", "double")]
    return report.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in real}).drop("config_id")


def report_by_error(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_synthetic_links(spark, sf).report_by_error())


def report_gold(spark: SparkSession, sf: str) -> DataFrame:
    people = stored_people(spark, sf)
    a, b = gold_sides(people, inject_errors(people, WEIGHTS, SEED))
    return _rounded(linkage.link_gold(a, b, GOLD_COLUMNS, [GOLD]).report_overall())


def link_repeated_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids that repeat on both sides: the last record of an id stands in A, every row of B is searched."""
    people = stored_people(spark, sf)
    damaged = inject_errors(people, WEIGHTS, SEED)
    b = damaged.unionByName(exchanged(damaged.where(F.col("id") % 20 == 5))).withColumn("check", F.col("id"))
    found = linkage.link_gold(with_repeated_ids(people), b, ATTRS, [MAIN], last_of_id=True)
    return found.matches.select("id", "best_a", F.round("dice", 6).alias("dice"), "hit")


def _copy_links(spark: SparkSession, sf: str) -> linkage.Links:
    people = stored_people(spark, sf)
    return linkage.link_synthetic(with_copies(people), side_b(people), [MAIN])


def candidate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _copy_links(spark, sf).candidate_pairs(["id"])
    return pairs.select("id", "id_a", F.round("dice", 6).alias("dice"))


def candidate_map_copies(spark: SparkSession, sf: str) -> DataFrame:
    """All candidate records by the maps of the export form, and the size of each B record's map."""
    maps = _copy_links(spark, sf).candidate_maps(["id"])
    counted = maps.select("id", F.col("busca.pares_candidatos").alias("m"), F.col("busca.baseA").alias("best_a"))
    return counted.select("id", "best_a", F.size("m").cast("bigint").alias("entries"), F.explode("m").alias("id_a", "value")).select(
        "id", "best_a", "entries", "id_a", F.round(F.col("value").cast("double"), 6).alias("dice")
    )


def pair_verdicts_copies(spark: SparkSession, sf: str) -> DataFrame:
    return _copy_links(spark, sf).verdicts().select("id", "VP", "FP", "VN", "FN")


def report_by_error_copies(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_copy_links(spark, sf).report_by_error())


def _triple_links(spark: SparkSession, sf: str) -> linkage.Links:
    people = stored_people(spark, sf)
    return linkage.link_synthetic(side_a(people), side_b(people), [replace(MAIN, hash=TRIPLE)])


def link_tree_triple(spark: SparkSession, sf: str) -> DataFrame:
    return _triple_links(spark, sf).matches.select("id", "error_type", "best_a", F.round("dice", 6).alias("dice"), "hit")


def report_by_error_triple(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_triple_links(spark, sf).report_by_error())


def sweep_from_file(spark: SparkSession, sf: str) -> DataFrame:
    """The sweep's 27 configurations, written as one JSON object, read back and linked."""
    path = fresh_path(spark, "sweep-object")
    entries = grid(spark).agg(F.map_from_entries(F.collect_list(F.struct("config", "body"))).alias("m"))
    entries.select(F.to_json("m").alias("value")).coalesce(1).write.text(path)
    people = stored_people(spark, sf)
    found = linkage.link_synthetic(side_a(people), side_b(people), to_configs(read_configs(spark, path), seed=SEED))
    return found.matches.select("config_id", "id", "error_type", "best_a", F.round("dice", 6).alias("dice"), "hit")


def slice_ties(spark: SparkSession, sf: str) -> DataFrame:
    """Slices of a table in the order of a key with few values: one near the head, one by ordinal."""
    columns = ["l_returnflag", "l_orderkey", "l_linenumber", "l_quantity"]
    lines = read_table(spark, f"{sf}/lineitem.parquet").select(*columns)
    head = rows_between(lines, 0, 50, ["l_returnflag"]).select(F.lit("head").alias("slice"), *columns)
    middle = rows_between(lines, 12000, 12100, ["l_returnflag"]).select(F.lit("middle").alias("slice"), *columns)
    return head.unionByName(middle)


def folder_scan(spark: SparkSession, sf: str) -> DataFrame:
    """People written as a folder of delimited files per state, and read as one table."""
    path = fresh_path(spark, "states")
    people_of(spark, sf).select("id", "name", "state").write.partitionBy("state").option("header", True).csv(path)
    rows = read_folder(spark, path, "id bigint, name string", by="folder")
    return rows.select("id", "name", F.regexp_replace("table", "^state=", "").alias("table_name"))


def append_twice(spark: SparkSession, sf: str) -> DataFrame:
    """Results appended by error type, two times, and read back."""
    path = fresh_path(spark, "results")
    damaged = inject_errors(people_of(spark, sf), WEIGHTS, SEED).select("id", "state", F.col("error_type").alias("Tipo_erro"))
    for _ in range(2):
        append_results(damaged, path)
    return read_delimited(spark, path, schema="id bigint, state string, Tipo_erro string").select("Tipo_erro", "id", "state")


def append_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Results written twice under one run and once under another, and read back: each run's rows stand once."""
    path = fresh_path(spark, "results")
    damaged = inject_errors(people_of(spark, sf), WEIGHTS, SEED).select("id", "state", F.col("error_type").alias("Tipo_erro"))
    append_results(damaged, path, run="first/1")
    append_results(damaged.where("id % 2 = 0"), path, run="second")
    append_results(damaged.where("id % 3 = 0"), path, run="first/1")
    rows = read_delimited(spark, path, schema="id bigint, state string, Tipo_erro string, run string")
    return rows.select("run", "Tipo_erro", "id", "state")


def sweep_links(spark: SparkSession, sf: str) -> DataFrame:
    people = stored_people(spark, sf)
    found = linkage.link_synthetic(side_a(people), side_b(people), SWEEP)
    return found.matches.select("config_id", "id", "error_type", "best_a", F.round("dice", 6).alias("dice"), "hit")


def zip_join(spark: SparkSession, sf: str) -> DataFrame:
    people = people_of(spark, sf)
    first = stratified_sample(people, "state", FRACTION, "id", BASE_SEED).select("id", "name")
    second = stratified_sample(people, "state", FRACTION, "id", GUARDIAN_SEED).select(
        F.col("id").alias("id_2"), F.col("name").alias("guardian")
    )
    return zip_rows(first, second, ["id"], ["id_2"])


def synthetic_dates(spark: SparkSession, sf: str) -> DataFrame:
    people = people_of(spark, sf).select("id")
    orders = read_table(spark, f"{sf}/orders.parquet")
    return with_synthetic_date(people, orders, "o_orderdate", "id", SEED)


def synthetic(spark: SparkSession, sf: str) -> DataFrame:
    register, cities = _register(spark, sf)
    orders = read_table(spark, f"{sf}/orders.parquet")
    return synthetic_base(register, cities, orders, "o_orderdate", "id")


def all_queries() -> dict[str, Query]:
    return {
        "people_base": people_base,
        "register_join": register_join,
        "csv_roundtrip": csv_roundtrip,
        "slice_rows": slice_rows,
        "config_grid": config_grid,
        "config_parse": config_parse,
        "stratified_sample": stratified,
        "error_buckets": error_buckets,
        **DAMAGE_QUERIES,
        "corrupt_all": corrupt_all,
        "error_types": error_type_list,
        "bigrams": bigrams,
        "hash_double": _hash_query(DOUBLE, 3),
        "hash_enhanced": _hash_query(ENHANCED, 20),
        "hash_triple": _hash_query(TRIPLE, 3),
        "encode_abf": _encode_query(ABF_RUN),
        "encode_clk": _encode_query(MAIN),
        "encode_rlb": _encode_query(RLB_RUN),
        "encode_block30": encode_block30,
        "dense_filter": dense_filter,
        "tree_first_split": _first_splits(1),
        "tree_two_levels": _first_splits(2),
        "tree_leaves": tree_leaves,
        "tree_splits": tree_splits,
        "link_exhaustive": link_exhaustive,
        "link_tree": link_tree,
        "candidate_map": candidates,
        "roc_points": roc_points,
        "roc_auc": roc_auc,
        "youden_threshold": youden_threshold,
        "hit_rate": hit_rate,
        "pair_verdicts": pair_verdicts,
        "report_by_error": report_by_error,
        "report_gold": report_gold,
        "sweep_links": sweep_links,
        "sweep_from_file": sweep_from_file,
        "link_tree_triple": link_tree_triple,
        "report_by_error_triple": report_by_error_triple,
        "link_repeated_ids": link_repeated_ids,
        "candidate_pairs": candidate_pairs,
        "candidate_map_copies": candidate_map_copies,
        "pair_verdicts_copies": pair_verdicts_copies,
        "report_by_error_copies": report_by_error_copies,
        "slice_ties": slice_ties,
        "folder_scan": folder_scan,
        "append_results": append_twice,
        "append_runs": append_runs,
        "zip_join": zip_join,
        "synthetic_dates": synthetic_dates,
        "synthetic_base": synthetic,
    }
