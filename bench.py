"""Times the headline steps and queries and prints one JSON line.

BENCH_SF_DIR  folder of the input tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from veilink.operators import evaluate
from veilink.operators.corrupt import Roles, inject_errors
from veilink.operators.match import search_all, search_tree
from veilink.plans import catalog, linkage
from veilink.plans.people import gold_sides, side_a, side_b
from veilink.sources.store import store

FACTOR = 4
WHOLE_QUERIES = ("corrupt_all", "bigrams", "encode_rlb", "synthetic_base", "report_gold", "sweep_links")


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("veilink-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="veilink-bench-"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name: str, work):
        start = time.perf_counter()
        result = work()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
        return result

    def both_sides(people: DataFrame | None = None) -> linkage.Encoded:
        people = catalog.stored_people(spark, sf_dir) if people is None else people
        b = linkage.corrupted_b(side_b(people), [config]).withColumn("truth", F.col("id"))
        found = linkage.encode_sides(side_a(people), b, attributes, attributes, [config], keep)
        return linkage.Encoded(found.a, found.distinct, store(found.b, "encoded-b").frame, found.size)

    config, attributes = catalog.MAIN, Roles().attributes
    keep = ["id", "truth", "error_type", "has_partner"]
    timed("warm_up", lambda: drain(catalog.people_of(spark, sf_dir)))
    encoded = timed("encode", both_sides)
    tree = timed("tree_build", encoded.index)
    matches = timed("route_match", lambda: store(evaluate.with_hit(search_tree(tree, encoded.b, keep)), "matches").frame)
    links = linkage.Links(matches, encoded, [config], {config.config_id: config.config_id})
    timed("report", lambda: links.report_by_error().collect())
    timed("exhaustive", lambda: drain(search_all(encoded.distinct, encoded.b, keep)))

    # the same at FACTOR times the people: there the index has to pay
    def more_people() -> DataFrame:
        people = catalog.stored_people(spark, sf_dir)
        copies = people.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(FACTOR - 1))))
        renamed = F.concat_ws(" ", "name", F.substring(F.md5(F.concat_ws(":", "id", "i")), 1, 6))
        larger = copies.withColumn("id", F.col("id") * FACTOR + F.col("i")).withColumn("name", renamed).drop("i")
        return store(larger, "larger").frame

    larger = timed(f"encode_x{FACTOR}", lambda: both_sides(more_people()))
    wide = timed(f"tree_build_x{FACTOR}", larger.index)
    timed(f"route_match_x{FACTOR}", lambda: drain(search_tree(wide, larger.b, keep)))
    timed(f"exhaustive_x{FACTOR}", lambda: drain(search_all(larger.distinct, larger.b, keep)))

    # report_gold by its steps
    people = catalog.stored_people(spark, sf_dir)
    gold_a, gold_b = gold_sides(people, inject_errors(people, catalog.WEIGHTS, catalog.SEED))
    gold_b = gold_b.withColumn("truth", F.col("check"))

    def gold_encode() -> linkage.Encoded:
        found = linkage.encode_sides(gold_a, gold_b, catalog.GOLD_COLUMNS, catalog.GOLD_COLUMNS, [catalog.GOLD], ["id", "truth"])
        return linkage.Encoded(found.a, found.distinct, store(found.b, "encoded-b").frame, found.size)

    gold = timed("gold_encode", gold_encode)
    gold_tree = timed("gold_tree", gold.index)
    timed("gold_match", lambda: drain(search_tree(gold_tree, gold.b, ["id", "truth"])))
    queries = catalog.all_queries()
    for name in WHOLE_QUERIES:
        timed(name, lambda: drain(queries[name](spark, sf_dir)))
    rows_a, rows_b = encoded.a.rows, encoded.b.count()
    counted = {name: s for name, s in seconds.items() if name != "warm_up"}
    result = {
        "metric": "total_seconds",
        "value": round(sum(counted.values()), 3),
        "unit": "sec",
        "queries": counted,
        "sf": os.path.basename(sf_dir),
        "rows": {"a": rows_a, "b": rows_b},
        "rows_per_sec": {
            "encode": round((rows_a + rows_b) / seconds["encode"], 1),
            "tree_build": round(rows_a / seconds["tree_build"], 1),
            "route_match": round(rows_b / seconds["route_match"], 1),
            "report": round(rows_b / seconds["report"], 1),
            "exhaustive": round(rows_b / seconds["exhaustive"], 1),
        },
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
