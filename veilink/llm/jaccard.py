"""Similarity classes of documents by word shingles: a T-occurrence search over inverted lists (DivideSkip).

Two documents link when their shingle sets have a Jaccard similarity of at least ``percent`` / 100.  A partner of a
document with n shingles must occur in at least T of the n inverted lists of its shingles, T = ceil(percent * n / 100).
The n - T + 1 shortest lists therefore hold every partner at least once: these are merged, and of the T - 1 long lists
none is ever read -- whether a candidate is in the list of a shingle is found by a binary probe of the candidate's
sorted set, until the needed overlap is reached or out of reach.

Steps
1. One round over chunks (see ``chunks``) tells of each shingle in how many chunks it occurs.  Shingles of a single
   document stand in no list; a document with fewer than T shared shingles is alone and drops out here, as nearly all
   distinct texts do.  Equal sets are one representative from here on.
2. Merging: each short list ties its members to its smallest one (a star, as many rows as the list), candidates are
   probed, and true links are joined into classes.  Then only lists with members of different classes are merged in
   full, and only pairs across classes are candidates.  A pair that is left out lies within one class already, so the
   classes are those of all links.
Filters by size and by place in the common order apply to every candidate and lose no link.

Representatives are written once in buckets of their id, and all joins by id read these: their shingles travel once.

Defined results: no words or null text: empty set, linked with nothing; fewer words than a shingle: the whole sequence
as one; a null id is linked with nothing (null class); rows that repeat an id are one node of the link graph, with the
links of each of their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veilink.llm import chunks, words
from veilink.llm.chunks import Chunk
from veilink.llm.components import components
from veilink.sources.store import Stored, store

BUCKET_BYTES = 16 << 20
SETS = "doc_id long, n long, items array<long>"
PAIRS = "a long, b long"


def _shingles(chunk: Chunk, size: int):
    """Sorted (shingle, document) entries without repeats, with the distinct shingles and their entry counts."""
    first, last, bounds = words.word_spans(chunk.data, chunk.offsets)
    single = words.word_names(chunk.data, first, last, fold_case=True)
    names = words.chain(single, size)
    doc = np.repeat(np.arange(len(chunk.ids)), np.diff(bounds))
    full = words.room(bounds, len(first)) >= size
    keys, docs = [names[full]], [doc[full]]
    counts = np.diff(bounds)
    for n in range(1, size):
        which = np.flatnonzero(counts == n)
        if len(which):
            keys.append(words.mix(words.chain(single, n)[bounds[which]] + np.uint64(n)))
            docs.append(which)
    key, doc = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[new], doc[new]
    found, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    return doc, found, inverse, count


def _spread(group: np.ndarray, count: np.ndarray, chunk_of: np.ndarray, owner_of) -> np.ndarray:
    """Answer: in how many chunks the shingle occurs, 255 and more as 255."""
    return np.minimum(count, 255)[group]


def needed(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def shared_sets(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> Stored:
    """(doc_id, n, items): the set size, and the shared shingles from rare to common where enough are shared."""
    base = chunks.write_chunks(docs, id_col, text_col, "shingles")

    def keys_of(chunk: Chunk):
        return _shingles(chunk, size)[1], None

    def use(chunk: Chunk, said: np.ndarray) -> list[dict]:
        doc, found, inverse, count = _shingles(chunk, size)
        total = np.bincount(doc, minlength=len(chunk.ids))
        shared = ((said > 1) | (count > 1))[inverse] if len(found) else np.zeros(0, bool)
        some = np.bincount(doc[shared], minlength=len(chunk.ids))
        place = inverse[shared]
        order = np.lexsort((found[place], said[place], doc[shared]))
        items = found[place][order].view(np.int64)
        ends = np.cumsum(some)
        rows = []
        for i, n in enumerate(total.tolist()):
            able = n and chunk.ids[i] != chunks.NO_ID and some[i] >= needed(n, percent)
            rows.append({
                "doc_id": None if chunk.ids[i] == chunks.NO_ID else int(chunk.ids[i]), "n": n,
                "items": items[ends[i] - some[i] : ends[i]] if able else None,
            })
        return rows

    bits = chunks.range_bits(base.seen["bytes"] / 6)
    answers = chunks.ask(base.frame, keys_of, bits, 4, _spread)
    items = F.coalesce(F.sum(F.size(F.coalesce("items", F.array())).cast("long")), F.lit(0).cast("long"))
    sets = store(chunks.told(base.frame, answers, use, SETS), "sets", items=items)
    base.drop()
    return sets


def _short_lists(sets: DataFrame, percent: int, *more: str) -> DataFrame:
    """(shingle, doc_id, n, place) of the short lists; place counts from the rarest of the document's whole set."""
    alone = F.col("n") - F.size("items")
    short = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1 - alone
    rows = sets.where(short > 0).select("doc_id", "n", alone.alias("alone"), *more, F.posexplode(F.slice("items", 1, short.cast("int"))))
    return rows.select(F.col("col").alias("shingle"), "doc_id", "n", (F.col("alone") + F.col("pos")).alias("place"), *more)


def _possible(percent: int) -> str:
    """Both sizes and the places of the common shingle leave room for the overlap that a link needs."""
    need = f"{percent} * (a_n + b_n)"
    return (
        f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)"
        f" AND {100 + percent} * least(a_n - a_place, b_n - b_place) >= {need}"
    )


def _side(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(c) if c == "shingle" else F.col(c).alias(f"{side}_{c}") for c in df.columns])


def _pairs(joined: DataFrame, percent: int) -> DataFrame:
    kept = joined.where(_possible(percent))
    return kept.select(F.least("a_doc_id", "b_doc_id").alias("a"), F.greatest("a_doc_id", "b_doc_id").alias("b")).where("a <> b").distinct()


def probed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The candidates that are links: b's long lists are probed for a by searching a's shingles in b's sorted set."""
    schema = chunks.arrow_schema(PAIRS)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            a_n, b_n = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i in range(batch.num_rows):
                a = batch.column(4)[i].values.to_numpy()
                b = np.sort(batch.column(5)[i].values.to_numpy())
                need, got = -(-percent * (a_n[i] + b_n[i]) // (100 + percent)), 0
                for at in range(0, len(a), 256):  # rare shingles first
                    part = a[at : at + 256]
                    spot = np.minimum(np.searchsorted(b, part), len(b) - 1)
                    got += int((b[spot] == part).sum())
                    if got >= need or got + len(a) - at - len(part) < need:
                        break
                kept.append(got >= need)
            mask = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], schema=schema)

    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("a_n"), F.col("items").alias("a_items"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("b_n"), F.col("items").alias("b_items"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "a_n", "b_n", "a_items", "b_items")
    return met.mapInArrow(chunks.tidy(probe), PAIRS)


def similarity_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    stored = shared_sets(docs, id_col, text_col, size, percent)
    sizes = store(stored.frame.select("doc_id", "n"), "set-sizes").frame
    same = ["n", "k1", "k2"]
    able = stored.frame.where("items IS NOT NULL").withColumns({"k1": F.xxhash64("items"), "k2": F.hash("items")})
    # equal sets: one representative; a set with shingles of its own has no equal
    own = F.when(F.size("items") < F.col("n"), F.col("doc_id"))
    keyed = able.select("doc_id", *same, own.alias("own"))
    kept = keyed.where("own IS NULL").groupBy(*same).agg(F.min("doc_id").alias("rep"))
    twins = keyed.where("own IS NULL").join(kept, same).select(F.col("doc_id").alias("b"), F.col("rep").alias("a"), *same).where("a <> b")
    twins = store(twins, "twins")
    # only the equal set goes: another text of the same id has links of its own.  Ranges instead of equalities leave the join
    # to the id, so that the shingles are dealt out by it and no further time for their buckets
    gone = twins.frame.select("b", *[F.col(c).alias(f"b_{c}") for c in same]).distinct()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-8 * stored.seen["items"] // BUCKET_BYTES))
    met = F.col("doc_id") == F.col("b")
    for c in same:
        met &= (F.col(c) >= F.col(f"b_{c}")) & (F.col(c) <= F.col(f"b_{c}"))
    dealt = able.select("doc_id", "n", "items", "k1", "k2").repartition(parts, "doc_id")
    whole = store(dealt.join(gone, met, "left_anti").drop("k1", "k2"), "representatives", buckets=(parts, "doc_id"))
    reps = whole.frame
    stored.drop()  # what follows needs the representatives' items and all sizes

    lists = _short_lists(reps, percent)
    head = F.min_by(F.struct("doc_id", "n", "place"), "doc_id")
    heads = lists.groupBy("shingle").agg(head.alias("h"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    heads = heads.select("shingle", F.col("h.doc_id").alias("a_doc_id"), F.col("h.n").alias("a_n"), F.col("h.place").alias("a_place"))
    stars = _pairs(_side(lists, "b").join(heads, "shingle"), percent)
    links = store(probed(stars, reps, percent).unionByName(twins.frame.select("a", "b")), "links").frame
    twins.drop()
    classes = store(components(links), "classes").frame

    labelled = reps.join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    labelled = labelled.withColumn("class", F.coalesce("component", "doc_id")).drop("component")
    lists = _short_lists(labelled, percent, "class")
    mixed = lists.groupBy("shingle").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("shingle")
    shared = store(lists.join(mixed, "shingle"), "mixed")
    across = _side(shared.frame, "a").join(_side(shared.frame, "b"), "shingle").where("a_class < b_class")
    more = store(probed(_pairs(across, percent), reps, percent), "links")
    shared.drop()
    whole.drop()
    if more.rows:
        classes = store(components(links.unionByName(more.frame)), "classes").frame
    return sizes.join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )
