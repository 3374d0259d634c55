"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

Trusted text is what ``labels`` calls good and not toxic.  Documents fall into two folds by a hash of id.  The model of a
fold is fitted on all of its trusted documents (a caller may ask for at most ``per_language`` of each language, those with
the smallest hashes of id), and every document is scored by the model of the other fold, at every size of the input: no text
is judged, and no threshold set, by a model that has seen it.

    p3(w | u v) = (c(uvw) - D3) / c(uv.) + g3(uv) p2(w | v)
    p2(w | v)   = (N(.vw) - D2) / N(.v.) + g2(v) p1(w)
    p1(w)       = (N(.w) - D1) / N(..) + g1 / (V + 1)

with three discounts per order from the counts of counts, and c, N the counts and the numbers of distinct left
neighbours.  A document is scored over its lower-cased words and an end mark.  Two ways give the same figures:

* Up to SENT_BYTES of fitted text: counts, continuation counts, context totals and discounts are aggregations over one
  exchange by middle word, and the table (one discounted share per n-gram, one weight per context) is sent to all tasks,
  which join the n-grams of a batch of texts with it by sorted search.
* Beyond, nothing is sent whole (``by_rounds``): texts lie in chunks of one fold, and three rounds over key ranges, of
  trigrams, of pairs and of words, add up what all chunks hold of a name and answer each chunk for its own names.  Of the
  chunks that hold an n-gram of a model one is told so and counts it for the next order, so every distinct n-gram counts
  once and a frequent word costs an entry for each chunk.

A document is rejected if its mean log10 perplexity exceeds the threshold of its language: a high quantile over its
trusted documents, plus a margin.  Means are drawn to the language's median with the weight of ``prior`` words, as a few
words say little.  A language's quantile is drawn, with the weight of OWN_WEIGHT documents, to its median plus the
quantile of all languages' distances from their medians, by one rule for any number of trusted documents; the null
language uses the trusted documents of all.

A mean over hundreds of words dilutes a few bad ones, so each fold has a second model, of its rejected documents (low
quality or toxic).  The contrast of a word is the difference of its log10
probabilities p1 under both; these count the distinct left neighbours of a word, so a passage that one rejected document
holds says little and a word that stands in many of them says much.  A document is also rejected if the mean contrast of
its worst window of 2 words (single words) or of 32 (style) exceeds the same quantile of its language's trusted documents.

Defined results: null or empty text has the end mark alone and is judged like a short text; a null id or language is
kept as it is; repeated ids are judged each; languages without trusted documents are kept, and everything is if a fold
has none; where the model of rejected text has no documents, the other fold's contrasts are null and not judged.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from veilink.llm import chunks, words
from veilink.sources.store import Stored, store

QUANTILE, MARGIN, PRIOR = 0.995, 0.15, 20
WINDOWS = {"worst_words": 2, "worst_passage": 32}
OWN_WEIGHT = 50
EDGE, LAST = np.uint64(0x5EED), np.uint64(0xE0D)
SLICE_BYTES = 1 << 20
TASK_DOCUMENTS = 128  # fitted documents whose n-grams are counted and sorted in one task
SENT_BYTES = 8 << 20  # of fitted text whose models are sent whole
CHUNK_BYTES, BUCKET_BYTES, RANGE_KEYS = 6 << 20, 16 << 20, 1_000_000
GOOD, BAD, NULL_TEXT = 1, 2, 4
ENTRIES = "range int, chunk long, n int, data binary"
ANSWERS = "chunk long, step int, range int, n int, data binary"
TURNS = {1: 2, 2: 3, 3: 2}  # trigrams, pairs and words are asked for in so many turns, so that a part of them is on disk at once
SCORED = 4  # parts of the texts that are scored one after the other
TOLD = {1: 1, 2: 5, 3: 6, 11: 1, 12: 2}  # values of a name in the answers of a step; above 10 those that are told once


def trusted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that the labels trust."""
    good = labels.where("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(good, id_col, "left_semi")


def rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that the labels call bad or toxic and none trusts."""
    bad = labels.where("(quality = 0 OR toxic = 1) AND doc_id IS NOT NULL").select(F.col("doc_id").alias(id_col)).distinct()
    good = trusted(bad, labels, id_col)
    return docs.join(bad.join(good, id_col, "left_anti"), id_col, "left_semi")


def fold(id_col: str) -> Column:
    """0 or 1 by a hash of id."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit("fold")), F.lit(2)).cast("int")


def fitting_sample(good: DataFrame, id_col: str, lang_col: str, per_language: int | None) -> DataFrame:
    """All ids with the fold as ``_m``, or at most ``per_language`` of each fold and language."""
    if per_language is None:
        return good.select(id_col, fold(id_col).alias("_m")).distinct()
    order = Window.partitionBy("_m", lang_col).orderBy(F.xxhash64(F.col(id_col)), id_col)
    first = good.select(id_col, lang_col, fold(id_col).alias("_m")).withColumn("_n", F.row_number().over(order))
    return first.where(F.col("_n") <= per_language).select(id_col, "_m").distinct()


def _grams(data: np.ndarray, offsets: np.ndarray):
    """Names of every token and its two predecessors; where each document begins."""
    first, last, bounds = words.word_spans(data, offsets)
    names = words.word_names(data, first, last, fold_case=True)
    lengths = np.diff(bounds) + 1
    begins = np.cumsum(lengths) - lengths
    w = np.full(int(lengths.sum()), LAST, np.uint64)
    inner = np.ones(len(w), bool)
    inner[begins + lengths - 1] = False
    w[inner] = names
    v, u = np.full_like(w, EDGE), np.full_like(w, EDGE)
    v[1:], u[2:] = w[:-1], w[:-2]
    v[begins] = EDGE
    u[begins] = EDGE
    later = begins + 1
    u[later[later < len(w)]] = EDGE
    return u, v, w, begins, lengths


def _trigrams(texts: DataFrame) -> DataFrame:
    schema = pa.schema([("m", pa.int32()), *[(c, pa.int64()) for c in "uvw"]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = words.arrow_run(batch.column(0))
            which = batch.column(1).to_numpy()
            for lo, hi in chunks.document_runs(offsets, SLICE_BYTES):
                u, v, w, _, lengths = _grams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                m = pa.array(np.repeat(which[lo:hi], lengths), pa.int32())
                yield pa.RecordBatch.from_arrays([m, *[pa.array(x.view(np.int64)) for x in (u, v, w)]], schema=schema)

    return texts.mapInArrow(chunks.tidy(cut), "m int, u long, v long, w long")


def _discounts(counts: DataFrame, column: str, models: int) -> list[list[float]]:
    """D1, D2, D3+ of the counts of an order, for every model; rows with a null count belong to another order."""
    rows = counts.groupBy("m").agg(*[F.count_if(F.col(column) == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).collect()
    found = {r.m: [max(1, r[f"n{i}"]) for i in (1, 2, 3, 4)] for r in rows}
    out = []
    for m in range(models):
        n = found.get(m, [1, 1, 1, 1])
        y = n[0] / (n[0] + 2 * n[1])
        out.append([min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.1), i + 0.9) for i in range(3)])
    return out


def _of_model(d: list[list[float]]) -> list[Column]:
    return [F.array(*[F.lit(x[i]) for x in d])[F.col("m")] for i in range(3)]


def _less(count: str, d: list[list[float]]) -> Column:
    c, of = F.col(count), _of_model(d)
    return F.when(c == 1, of[0]).when(c == 2, of[1]).otherwise(of[2])


def _left(ones: str, twos: str, more: str, total: str, d: list[list[float]]) -> Column:
    """Weight that a context leaves to the lower order, from the numbers of its n-grams met once, twice and more often."""
    taken = sum((F.col(n) * of for n, of in zip((ones, twos, more), _of_model(d), strict=True)), F.lit(0.0))
    return taken / F.col(total)


@dataclass
class Model:
    """Sorted n-gram names with the share and the context weight of each."""

    tri: np.ndarray
    tri_share: np.ndarray
    bi: np.ndarray
    bi_share: np.ndarray
    bi_left: np.ndarray
    uni: np.ndarray
    uni_share: np.ndarray
    uni_left: np.ndarray
    floor: float

    @staticmethod
    def _find(names: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(names):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(names, key), len(names) - 1)
        return at, names[at] == key

    def log10_word(self, w: np.ndarray) -> np.ndarray:
        """log10 of p1 of every token."""
        at, hit = self._find(self.uni, w)
        return np.log10(np.where(hit, self.uni_share[at] if len(self.uni) else 0, 0) + self.floor)

    def log10(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 probability of every token after its two predecessors."""
        at, hit = self._find(self.uni, w)
        p = np.where(hit, self.uni_share[at] if len(self.uni) else 0, 0) + self.floor
        for names, share, key, left_names, left, context in (
            (self.bi, self.bi_share, words.pair(v, w), self.uni, self.uni_left, v),
            (self.tri, self.tri_share, words.pair(words.pair(u, v), w), self.bi, self.bi_left, words.pair(u, v)),
        ):
            at, known = self._find(left_names, context)
            weight = np.where(known, left[at] if len(left) else 1, 1)
            at, hit = self._find(names, key)
            p = np.where(hit, share[at] if len(share) else 0, 0) + weight * p
        return np.log10(p)


def fit(texts: DataFrame) -> Model:
    """The model of a bounded table of texts (one column)."""
    return fit_each(texts.select(F.col(f"`{texts.columns[0]}`").alias("t"), F.lit(0).alias("m")), 1)[0]


def _counts(texts: DataFrame, whole: Column, parts: int | None = None) -> DataFrame:
    """A row per distinct trigram of a model, with the figures of all orders but the lowest.

    ``tri``, ``c``: the trigram's name and count; ``total``: count of its context (u, v).  In one row of each context:
    its name ``context`` and the numbers of its trigrams met once, twice and more often.  In one row of each pair (v, w):
    its name ``bi``, ``v``, ``w``, the number ``n`` of its left neighbours and ``of`` their sum over the pairs of v.
    Every key holds the middle word, so one exchange by it serves all orders; a frequent word's rows are sorted, and
    bounded by the sample.  A model of words alone has only pairs.  The sorts hold many times what the exchange moves, so
    ``parts``, not the bytes moved, says how many tasks share them.
    """
    grams = _trigrams(texts).withColumn("u", F.when(whole, F.col("u")).otherwise(F.lit(0)))  # p1 counts pairs
    rows = grams.repartition(*([parts] if parts else []), "m", "v").groupBy("m", "v", "u", "w").agg(F.count(F.lit(1)).alias("c"))
    context, pair, middle = (Window.partitionBy("m", "v", *k) for k in (["u"], ["w"], []))
    rows = rows.select(
        "*", whole.alias("whole"), F.sum("c").over(context).alias("total"), (F.min("w").over(context) == F.col("w")).alias("heads"),
        F.count_if(F.col("c") == 1).over(context).alias("ones"), F.count_if(F.col("c") == 2).over(context).alias("twos"),
        F.count_if(F.col("c") > 2).over(context).alias("more"),
    )
    rows = rows.select("*", F.count(F.lit(1)).over(pair).alias("n"), (F.min("u").over(pair) == F.col("u")).alias("ends"))
    rows = rows.select("*", F.count(F.lit(1)).over(middle).alias("of"))
    fields = "m int, tri long, c long, total long, context long, ones long, twos long, more long, bi long, v long, w long, n long, of long"
    names = [f.split()[0] for f in fields.split(", ")]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, w = (batch.column(c).to_numpy().view(np.uint64) for c in "uvw")
            full, heads, ends = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("whole", "heads", "ends"))
            number = {c: batch.column(c).to_numpy() for c in ("c", "total", "ones", "twos", "more", "n", "of")}
            number |= {"tri": words.pair(words.pair(u, v), w).view(np.int64), "context": words.pair(u, v).view(np.int64)}
            number |= {"bi": words.pair(v, w).view(np.int64), "v": v.view(np.int64), "w": w.view(np.int64)}
            where = dict.fromkeys(("tri", "c", "total"), full) | dict.fromkeys(("context", "ones", "twos", "more"), full & heads)
            where |= dict.fromkeys(("bi", "v", "n", "of"), full & ends) | {"w": ends}
            yield pa.RecordBatch.from_arrays([batch.column("m"), *[pa.array(number[c], mask=~where[c]) for c in names[1:]]], names=names)

    return rows.mapInArrow(chunks.tidy(named), fields)


def fit_each(texts: DataFrame, models: int, words_only: int = 0, parts: int | None = None) -> list[Model]:
    """The models of a bounded table of (text, number of the model); the last ``words_only`` models have p1 alone."""
    stored = store(_counts(texts, F.col("m") < models - words_only, parts), "kn-counts")
    rows = stored.frame
    d3, d2 = _discounts(rows, "c", models), _discounts(rows, "n", models)
    c1 = store(rows.where("w IS NOT NULL").groupBy("m", "w").agg(F.count(F.lit(1)).alias("c")), "kn-1").frame
    d = _discounts(c1, "c", models)
    sums = c1.groupBy("m").agg(F.sum("c").alias("n"), F.sum(_less("c", d)).alias("taken"), F.count(F.lit(1)).alias("v"))
    share1 = c1.join(sums.select("m", "n"), "m").select("m", "w", ((F.col("c") - _less("c", d)) / F.col("n")).alias("share"))
    met = rows.where("bi IS NOT NULL").groupBy("m", F.col("v").alias("w"))
    left2 = met.agg(F.max("of").alias("of"), *[F.count_if(x).alias(c) for c, x in (("ones", F.col("n") == 1), ("twos", F.col("n") == 2), ("more", F.col("n") > 2))])
    one = share1.join(left2.select("m", "w", _left("ones", "twos", "more", "of", d2).alias("left")), ["m", "w"], "full")

    def column(df: DataFrame, name: str, *values: Column) -> list[np.ndarray]:
        """Sorted names and their values; a model's part of the bounded tables."""
        table = df.where(F.col(name).isNotNull()).select(name, *[v.cast("float").alias(f"v{i}") for i, v in enumerate(values)]).toArrow()
        names = table[name].to_numpy().view(np.uint64)
        order = np.argsort(names)
        return [names[order], *[table[f"v{i}"].to_numpy()[order] for i in range(len(values))]]

    def spread(names: np.ndarray, own: np.ndarray, values: np.ndarray, other: float) -> np.ndarray:
        out = np.full(len(names), other, np.float32)
        out[np.searchsorted(names, own)] = values
        return out

    floors = {r.m: r.taken / r.n / (r.v + 1) for r in sums.collect()}
    out = []
    for m in range(models):
        mine = rows.where(F.col("m") == m)
        single = column(one.where(F.col("m") == m), "w", F.coalesce("share", F.lit(0.0)), F.coalesce("left", F.lit(1.0)))
        if m < models - words_only:
            tri, tri_share = column(mine, "tri", (F.col("c") - _less("c", d3)) / F.col("total"))
            bi, bi_share = column(mine, "bi", (F.col("n") - _less("n", d2)) / F.col("of"))
            context, left = column(mine, "context", _left("ones", "twos", "more", "total", d3))
            both = np.union1d(bi, context)
            higher = [tri, tri_share, both, spread(both, bi, bi_share, 0.0), spread(both, context, left, 1.0)]
        else:
            higher = [np.zeros(0, t) for t in (np.uint64, np.float32, np.uint64, np.float32, np.float32)]
        out.append(Model(*higher, *single, floors.get(m, 1.0)))
    stored.drop()
    return out


def _worst(value: np.ndarray, begins: np.ndarray, lengths: np.ndarray, window: int) -> np.ndarray:
    """Largest sum over ``window`` tokens of every document, divided by ``window``."""
    sums = np.concatenate(([0.0], np.cumsum(value)))
    ends = np.arange(1, len(sums))
    return np.maximum.reduceat(sums[ends] - sums[np.maximum(ends - window, np.repeat(begins, lengths))], begins) / window


def send(spark: SparkSession, models: list[Model]) -> Broadcast:
    """The models as plain arrays to all tasks; executors keep a copy of each one sent, so it is sent once for all passes.

    ``models``: trusted text of both folds, then rejected text of both.
    """
    bad = [{"uni": m.uni, "uni_share": m.uni_share, "floor": m.floor} for m in models[2:]]
    return spark.sparkContext.broadcast(([vars(m) for m in models[:2]], bad))


def scored(docs: DataFrame, models: list[Model], id_col: str, text_col: str, keep: list[str], sent: Broadcast | None = None) -> DataFrame:
    """Columns ``keep`` with ``n_tokens``, ``log10_prob`` of the whole text and the contrasts, by the models of the other fold.

    ``models``: as in ``send``, whose result is ``sent``.
    """
    contrasted = np.array([bool(len(good.uni) and len(bad.uni)) for good, bad in zip(models[:2], models[2:], strict=True)])
    sent = sent or send(docs.sparkSession, models)
    clear = "_" * max(map(len, docs.columns))  # longer than any name in use
    kept = docs.select(*keep)
    # a text that is kept anyway travels once
    seen = keep.index(text_col) + 1 if text_col in keep and kept.schema[text_col].dataType.typeName() == "string" else None
    text = [] if seen else [F.col(text_col).cast("string").alias(f"{clear}t")]
    place, at = len(text), seen or 0
    picked = docs.select(*text, (1 - fold(id_col)).alias(f"{clear}m"), *keep)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        good, bad = sent.value
        tables = [Model(**m) for m in good]
        others = [Model(none, none, none, none, none, m["uni"], m["uni_share"], none, m["floor"]) for m in bad]
        for batch in batches:
            data, offsets = words.arrow_run(batch.column(at))
            for lo, hi in chunks.document_runs(offsets, SLICE_BYTES):
                u, v, w, begins, lengths = _grams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                part = batch.slice(lo, hi - lo)
                which = part.column(place).to_numpy()
                by, logs, contrast = np.repeat(which, lengths), np.empty(len(w)), np.zeros(len(w))
                for m, (table, other) in enumerate(zip(tables, others, strict=True)):
                    mine = by == m
                    logs[mine] = table.log10(u[mine], v[mine], w[mine])
                    if contrasted[m]:
                        contrast[mine] = other.log10_word(w[mine]) - table.log10_word(w[mine])
                logs = np.add.reduceat(logs, begins)
                worst = [pa.array(_worst(contrast, begins, lengths, n), pa.float64(), mask=~contrasted[which]) for n in WINDOWS.values()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[place + 1 :], pa.array(lengths, pa.int64()), pa.array(logs, pa.float64()), *worst],
                    names=[*part.schema.names[place + 1 :], "n_tokens", "log10_prob", *WINDOWS],
                )

    return picked.mapInArrow(chunks.tidy(judge), f"{ddl}, n_tokens long, log10_prob double" + "".join(f", {c} double" for c in WINDOWS))


def _dealt(docs: DataFrame, chosen: Stored, id_col: str, text_col: str, keep: list[str], parts: int) -> tuple[Stored, bool]:
    """Texts in chunks of one fold (the lowest bit of the number), in buckets of it, with what each is fitted for and the columns ``keep``.

    Also says whether the text is one of these columns; it is then made from the chunk's bytes again.
    """
    seen = text_col in keep and docs.schema[text_col].dataType.typeName() == "string"
    others = F.struct(*[F.col(c) for c in keep if not (seen and c == text_col)])
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), fold(id_col).alias("f"), others.alias("r"))
    marks = chosen.small_side(64).select(F.col(id_col).alias("i"), F.when(F.col("_m") > 1, BAD).otherwise(GOOD).alias("mark"))
    rows = rows.join(marks, "i", "left").select("t", "f", F.coalesce("mark", F.lit(0)).alias("mark"), "r")
    schema = T.StructType.fromDDL("chunk long, sizes array<int>, flags array<int>, data binary").add("rest", T.ArrayType(rows.schema["r"].dataType))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        held: list[tuple] = [([], [], [], []), ([], [], [], [])]
        size = [0, 0]

        def flush(f: int) -> pa.RecordBatch:
            nonlocal count
            data, sizes, flags, rest = held[f]
            number = (part << 32 | count) << 1 | f
            held[f], size[f], count = ([], [], [], []), 0, count + 1
            sizes = np.concatenate(sizes)
            ends = pa.array([0, len(sizes)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(sizes, pa.int32()), pa.array(np.concatenate(flags), pa.int32()), pa.concat_arrays(rest))]
            run = pa.array([chunks.squeeze(np.concatenate(data))], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), lists[0], lists[1], run, lists[2]], names=schema.names)

        for batch in batches:
            which = batch.column(1).to_numpy()
            for f in (0, 1):
                mine = batch.filter(pa.array(which == f))
                data, offsets = words.arrow_run(mine.column(0))
                flags = mine.column(2).to_numpy() + NULL_TEXT * mine.column(0).is_null().to_numpy(zero_copy_only=False)
                weight, begin = offsets + 8 * np.arange(len(offsets)), 0  # an empty text is a row as well
                while begin < mine.num_rows:
                    end = max(begin + 1, int(np.searchsorted(weight, weight[begin] + CHUNK_BYTES - size[f], "right")) - 1)
                    piece = (data[offsets[begin] : offsets[end]].copy(), np.diff(offsets[begin : end + 1]), flags[begin:end], mine.column(3).slice(begin, end - begin))
                    for to, x in zip(held[f], piece, strict=True):
                        to.append(x)
                    size[f] += int(weight[end] - weight[begin])
                    begin = end
                    if size[f] >= CHUNK_BYTES * 9 // 10:
                        yield flush(f)
        for f in (0, 1):
            if held[f][0]:
                yield flush(f)

    return store(rows.mapInArrow(chunks.tidy(pack), schema), "kn-chunks", buckets=(parts, "chunk")), seen


@dataclass
class _Tokens:
    """The tokens of a chunk, and for every name of an order where its tokens are."""

    number: int
    data: np.ndarray
    offsets: np.ndarray
    flags: np.ndarray
    u: np.ndarray
    v: np.ndarray
    w: np.ndarray
    lengths: np.ndarray

    @classmethod
    def read(cls, table: pa.Table | pa.RecordBatch, i: int = 0) -> "_Tokens":
        row = table.select(["chunk", "sizes", "flags", "data"]).slice(i, 1).to_pylist()[0]
        offsets, data = np.concatenate(([0], np.cumsum(np.asarray(row["sizes"], np.int64)))), chunks.loosen(row["data"])
        parts = [_grams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in chunks.document_runs(offsets, SLICE_BYTES)]
        u, v, w, _, lengths = (np.concatenate(x) for x in zip(*parts, strict=True))
        return cls(row["chunk"], data, offsets, np.asarray(row["flags"], np.int64), u, v, w, lengths)

    def marked(self, *marks: int) -> np.ndarray:
        """Whether a token's text is fitted for this."""
        return np.repeat(np.isin(self.flags & 3, marks), self.lengths)

    def trigrams(self, only: np.ndarray | None = None) -> np.ndarray:
        """Name of every token, or of those marked."""
        u, v, w = (x if only is None else x[only] for x in (self.u, self.v, self.w))
        return words.pair(words.pair(u, v), w)

    def _chained(self, edge: np.ndarray, names: np.ndarray, asked: Callable[[np.ndarray], np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct names with that of the edge, where the name before each token is, where its own is; -1 if not ``asked``."""
        found, at = _placed(np.concatenate((edge, names)), asked)
        before = np.empty(len(names), np.int64)
        before[1:] = at[1:-1]
        before[np.cumsum(self.lengths) - self.lengths] = at[0]
        return found, before, at[1:]

    def pairs(self, asked: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names, the name of each token's context (u, v), which is the pair before it, and of its pair (v, w)."""
        edge = np.array([EDGE])
        return self._chained(words.pair(edge, edge), words.pair(self.v, self.w), asked)

    def words(self, asked: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names, the name of each token's middle and last word."""
        return self._chained(np.array([EDGE]), self.w, asked)


def _placed(names: np.ndarray, asked: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct names that are ``asked`` for, and where in them each name is (else -1)."""
    if asked is None:
        return np.unique(names, return_inverse=True)
    here, at = asked(names), np.full(len(names), -1)
    found, at[here] = np.unique(names[here], return_inverse=True)
    return found, at


def _turn(step: int, turn: int, bits: int) -> Callable[[np.ndarray], np.ndarray]:
    """Whether names lie in the ranges of a turn."""
    return lambda names: (names >> np.uint64(64 - bits)).astype(np.int64) * TURNS[step] >> bits == turn


def _a_token(at: np.ndarray, names: int) -> np.ndarray:
    """A token of each name."""
    out = np.zeros(names, np.int64)
    out[at] = np.arange(len(at))
    return out


def _counted(at: np.ndarray, names: int, weights: np.ndarray | None = None) -> np.ndarray:
    """How often each name is met; -1 is none."""
    return np.bincount(at + 1, weights=weights, minlength=names + 1)[1:]


def _entries(number: int, names: np.ndarray, values: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """A chunk's sorted names and their values as rows for their ranges; 48 bits of a name follow the range's number."""
    present, begins = np.unique((names >> np.uint64(64 - bits)).astype(np.int32), return_index=True)
    rest, rows = (names << np.uint64(bits)) >> np.uint64(16), []
    ends = np.append(begins, len(names))[1:]
    for r, lo, hi in zip(present.tolist(), begins, ends, strict=True):
        steps = np.diff(rest[lo:hi], prepend=np.uint64(0))
        data = chunks.planes(np.concatenate([steps, *[x[lo:hi].astype(np.uint64) for x in values]]))
        rows.append({"range": r, "chunk": number, "n": int(hi - lo), "data": data})
    return pa.RecordBatch.from_pylist(rows, schema=chunks.arrow_schema(ENTRIES))


def _first(code: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The first of the marked entries of every code."""
    at, out = np.flatnonzero(which), np.zeros(len(code), bool)
    out[at[np.unique(code[at], return_index=True)[1]]] = True
    return out


def _figures(*sums: np.ndarray) -> np.ndarray:
    """Counts of counts up to 4, the sum and the number of names, for both models of every order given."""
    return np.array([[*[(c[m::2] == i).sum() for i in (1, 2, 3, 4)], c[m::2].sum(), (c[m::2] > 0).sum()] for c in sums for m in (0, 1)], np.int64)


def _settled(step: int, code: np.ndarray, values: np.ndarray) -> tuple[dict[int, tuple], np.ndarray]:
    """By number of the answer, which entries have one (None: all) and its values; the range's figures.

    ``code``: twice the number of the name, plus the chunk's fold.
    """
    n = 2 * (int(code.max()) // 2 + 1)
    sums = [np.bincount(code, weights=x, minlength=n).astype(np.int64) for x in values]
    other = [x[code ^ 1] for x in sums]
    if step == 1:  # trigrams: their count in the other fold; up to 3 of the own one
        fitted = values[0] > 0
        own = np.where(_first(code, fitted), np.minimum(sums[0][code], 3), 0)
        return {1: (None, other), 11: (fitted, [own])}, _figures(sums[0])
    if step == 2:  # pairs: total, ones, twos, more as context, left neighbours; those in the own fold, and rejected ones
        own = np.where(_first(code, values[4] > 0), sums[4][code], 0)
        return {2: (None, other[:5]), 12: (values[5] > 0, [own, _first(code, values[5] >= BAD)])}, _figures(sums[4])
    return {3: (None, other)}, _figures(sums[4], sums[5])  # words: sum, ones, twos, more as context, left neighbours in both texts


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Files of the exchanges of what is written within it go as soon as it is written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _asked(entries: list[DataFrame], step: int, values: int) -> tuple[list[Stored], np.ndarray]:
    """A round, in one or more turns: the answers to all entries, and the figures of all ranges together."""

    def settle(table: pa.Table) -> pa.Table:
        chunks.give_back()
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        parts = [chunks.unplanes(r["data"], r["n"] * (1 + values), "uint64").reshape(1 + values, -1) for r in rows]
        sizes = np.array([r["n"] for r in rows])
        name = np.unique(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), return_inverse=True)[1]
        code = 2 * name + np.repeat(np.array([r["chunk"] & 1 for r in rows]), sizes)
        said, figures = _settled(step, code, np.concatenate([p[1:] for p in parts], axis=1))
        begins, out = np.cumsum(sizes) - sizes, []
        for number, (which, answer) in said.items():
            each = sizes if which is None else np.add.reduceat(which.astype(np.int64), begins)
            answer = np.array(answer, np.uint64) if which is None else np.array(answer, np.uint64)[:, which]
            cut = np.split(answer, np.cumsum(each)[:-1], axis=1)
            out += [{"chunk": r["chunk"], "step": number, "range": r["range"], "n": int(k), "data": chunks.planes(a.ravel())} for r, a, k in zip(rows, cut, each, strict=True) if k]
        out.append({"chunk": -1, "step": step, "range": rows[0]["range"], "n": 0, "data": figures.tobytes()})
        return pa.Table.from_pylist(out, schema=chunks.arrow_schema(ANSWERS))

    answers = []
    for turn in entries:
        with _cleaned(turn.sparkSession):
            answers.append(store(turn.groupBy("range").applyInArrow(settle, ANSWERS), "kn-answers"))
    figures = _union(answers).where("chunk < 0").select("data").collect()
    return answers, np.sum([np.frombuffer(r.data, np.int64).reshape(-1, 6) for r in figures], axis=0)


def _union(tables: list[Stored]) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.frame for t in tables])


def _brought(whole: DataFrame, answers: list[Stored], steps: list[int], use: Callable[[pa.Table, dict], pa.Table], schema: T.StructType, part: int | None = None) -> DataFrame:
    """``use(chunk's row, values of its names by step)`` for every chunk, or for a part of them."""
    mine = F.lit(True) if part is None else F.pmod(F.xxhash64("chunk"), F.lit(SCORED)) == part
    empty = to_arrow_schema(schema).empty_table()

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty
        chunks.give_back()
        rows = sorted(right.to_pylist(), key=lambda r: (r["step"], r["range"]))
        said = {}
        for s in steps:
            parts = [chunks.unplanes(r["data"], r["n"] * TOLD[s], "uint64").reshape(TOLD[s], -1) for r in rows if r["step"] == s]
            said[s] = np.concatenate([np.zeros((TOLD[s], 0), np.uint64), *parts], axis=1).astype(np.int64)
        return use(left, said)

    told = _union(answers).where((F.col("chunk") >= 0) & F.col("step").isin(steps) & mine)
    return whole.where(mine).groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(meet, schema)


def _discounts_of(met: np.ndarray) -> np.ndarray:
    n = np.maximum(met[:4], 1)
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.1), i + 0.9) for i in range(3)])


def by_rounds(
    docs: DataFrame, chosen: Stored, id_col: str, text_col: str, keep: list[str], size: int
) -> tuple[Callable[..., DataFrame], bool, Callable[[], None]]:
    """``scored`` without a model in one place, for any of the columns ``keep`` (and a part of the texts); whether both folds have trusted text; how to end it.

    ``chosen``: ids and the number of the model they are fitted for; ``size``: bytes of all texts.
    """
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    dealt, seen = _dealt(docs, chosen, id_col, text_col, keep, parts)
    texts = dealt.frame.select("chunk", "sizes", "flags", "data")
    bits = chunks.range_bits(size / 7 * (chunks.RANGE_KEYS / RANGE_KEYS))  # some 7 bytes of text have a name
    entry = T.StructType.fromDDL(ENTRIES)

    def trigrams(turn: int) -> DataFrame:
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    t = _Tokens.read(batch, i)
                    names, at = _placed(t.trigrams(), _turn(1, turn, bits))
                    yield _entries(t.number, names, [_counted(at, len(names), t.marked(GOOD))], bits)

        return texts.mapInArrow(chunks.tidy(ask), ENTRIES)

    def pairs(turn: int) -> DataFrame:
        def ask(row: pa.Table, said: dict) -> pa.Table:
            t = _Tokens.read(row)
            own, good = said[11][0], t.marked(GOOD)
            token = np.flatnonzero(good)[_a_token(_placed(t.trigrams(good))[1], len(own))]
            names, context, pair = t.pairs(_turn(2, turn, bits))
            values = [_counted(context, len(names), good), *[_counted(context[token[own == i]], len(names)) for i in (1, 2, 3)]]
            # the chunk can tell the pairs of fitted texts again
            fitted = sum(mark * (_counted(pair[t.marked(mark)], len(names)) > 0) for mark in (GOOD, BAD))
            values += [_counted(pair[token[own > 0]], len(names)), fitted]
            return pa.Table.from_batches([_entries(t.number, names, values, bits)])

        return _brought(texts, one, [11], ask, entry)

    def single(turn: int) -> DataFrame:
        def ask(row: pa.Table, said: dict) -> pa.Table:
            t = _Tokens.read(row)
            (n, bad), fitted = said[12], t.marked(GOOD, BAD)
            token = np.flatnonzero(fitted)[_a_token(_placed(words.pair(t.v[fitted], t.w[fitted]))[1], len(n))]
            names, middle, last = t.words(_turn(3, turn, bits))
            own, of = n[n > 0], token[n > 0]
            values = [_counted(middle[of], len(names), own), *[_counted(middle[of[x]], len(names)) for x in (own == 1, own == 2, own > 2)]]
            values += [_counted(last[of], len(names)), _counted(last[token[bad > 0]], len(names))]
            return pa.Table.from_batches([_entries(t.number, names, values, bits)])

        return _brought(texts, two, [12], ask, entry)

    one, met3 = _asked([trigrams(turn) for turn in range(TURNS[1])], 1, 1)
    two, met2 = _asked([pairs(turn) for turn in range(TURNS[2])], 2, 6)
    three, met1 = _asked([single(turn) for turn in range(TURNS[3])], 3, 6)
    d3, d2, d1 = ([_discounts_of(m) for m in met] for met in (met3, met2, met1))
    # of the words: their sum, and the weight of one not met
    sums = [max(1, int(m[4])) for m in met1]
    floors = [(d[0] * m[0] + d[1] * m[1] + d[2] * (m[5] - m[0] - m[1])) / m[4] / (m[5] + 1) if m[5] else 1.0 for m, d in zip(met1, d1, strict=True)]
    some = [bool(m[5]) for m in met1]
    less = lambda c, d: d[np.minimum(c, 3) - 1]
    share = lambda c, d, total: np.where(c > 0, (c - less(c, d)) / np.maximum(total, 1), 0).astype(np.float32)
    left = lambda total, met, d: np.where(total > 0, sum(n * x for n, x in zip(met, d, strict=True)) / np.maximum(total, 1), 1).astype(np.float32)

    def figures(t: _Tokens, said: dict) -> list[pa.Array]:
        m, (count,), (total, ones, twos, more, n), (of, *met, c1, cb) = 1 - (t.number & 1), said[1], said[2], said[3]
        _, tri = _placed(t.trigrams())
        _, context, pair = t.pairs()
        _, middle, last = t.words()
        p1 = share(c1, d1[m], sums[m]) + float(floors[m])
        p = share(n[pair], d2[m], of[middle]) + left(of, met, d2[m])[middle] * p1[last]
        p = share(count[tri], d3[m], total[context]) + left(total, (ones, twos, more), d3[m])[context] * p
        begins = np.cumsum(t.lengths) - t.lengths
        logs = np.add.reduceat(np.log10(p).astype(np.float64), begins)
        out = [pa.array(t.lengths, pa.int64()), pa.array(logs, pa.float64())]
        if not (some[m] and some[2 + m]):
            return out + [pa.nulls(len(t.lengths), pa.float64())] * len(WINDOWS)
        contrast = (np.log10(share(cb, d1[2 + m], sums[2 + m]) + float(floors[2 + m])) - np.log10(p1)).astype(np.float64)[last]
        return out + [pa.array(_worst(contrast, begins, t.lengths, k), pa.float64()) for k in WINDOWS.values()]

    fields = {f.name: f for f in dealt.frame.schema["rest"].dataType.elementType.fields}
    if seen:
        fields[text_col] = T.StructField(text_col, T.StringType())

    def score(columns: list[str], part: int | None = None) -> DataFrame:
        added = [T.StructField("n_tokens", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("log10_prob", *WINDOWS)]]
        schema = T.StructType([*[fields[c] for c in columns], *added])
        types = to_arrow_schema(schema)

        def judge(row: pa.Table, said: dict) -> pa.Table:
            t = _Tokens.read(row)
            rest = row["rest"].combine_chunks().flatten()
            found = {f.name: rest.field(i) for i, f in enumerate(rest.type)}
            if seen:
                null = pa.array(t.flags & NULL_TEXT > 0)
                whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(t.lengths), [None, pa.py_buffer(t.offsets), pa.py_buffer(t.data)])
                found[text_col] = pc.if_else(null, pa.scalar(None, pa.string()), whole.cast(pa.large_string()).cast(pa.string()))
            arrays = [*[found[c] for c in columns], *figures(t, said)]
            return pa.Table.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, types, strict=True)], schema=types)

        return _brought(dealt.frame, [*one, *two, *three], [1, 2, 3], judge, schema, part)

    def drop() -> None:
        for table in (dealt, *one, *two, *three):
            table.drop()

    return score, some[0] and some[1], drop


def thresholds(good: DataFrame, lang_col: str, quantile: float, margin: float, prior: int) -> DataFrame:
    """(lang, middle, threshold, limits of the contrasts) from scored trusted rows; the null language stands for all of them."""
    rate = -F.col("log10_prob") / F.col("n_tokens")
    both = F.array_distinct(F.array(F.lit(None).cast("string"), F.col(lang_col).cast("string")))
    rows = good.select(F.explode(both).alias("lang"), rate.alias("rate"), "n_tokens", *WINDOWS)
    middle = rows.groupBy("lang").agg(F.percentile_approx("rate", 0.5, 10000).alias("middle"), F.count(F.lit(1)).alias("n"), *[F.percentile_approx(c, 0.5, 10000).alias(f"{c}_middle") for c in WINDOWS])
    drawn = (F.col("rate") * F.col("n_tokens") + F.col("middle") * prior) / (F.col("n_tokens") + prior)
    met = rows.join(F.broadcast(middle.withColumnRenamed("lang", "of")), F.expr("lang <=> of")).withColumn("rate", drawn)
    high = lambda c: F.percentile_approx(c, quantile, 10000)
    middles = {"rate": "middle"} | {c: f"{c}_middle" for c in WINDOWS}
    spread = met.where("lang IS NOT NULL").agg(*[high(F.col(c) - F.col(m)).alias(f"{c}_spread") for c, m in middles.items()])
    out = met.groupBy("lang", "n", *middles.values()).agg(*[high(c).alias(c) for c in middles]).crossJoin(F.broadcast(spread))
    pooled = lambda c: F.col(middles[c]) + F.col(f"{c}_spread")
    shrunk = lambda c: (F.col("n") * F.col(c) + OWN_WEIGHT * pooled(c)) / (F.col("n") + OWN_WEIGHT)
    limit = lambda c: F.when(F.col("lang").isNull(), F.col(c)).otherwise(shrunk(c))
    return out.select("lang", "middle", (limit("rate") + margin).alias("threshold"), *[limit(c).alias(c) for c in WINDOWS])


def judged(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int | None = None, quantile: float = QUANTILE, margin: float = MARGIN, prior: int = PRIOR, keep: list[str] | None = None,
) -> DataFrame:
    """Columns ``keep`` (id and language by default) with n_tokens, log10_prob, perplexity, threshold, contrasts with their limits, ``kept``.

    Texts are scanned, never shuffled: all are scored in one pass that keeps id, language and score, and once more only if
    ``keep`` asks for other columns.
    """
    named = docs.select(id_col, lang_col)
    good = fitting_sample(trusted(named, labels, id_col), id_col, lang_col, per_language)
    bad = fitting_sample(rejected(named, labels, id_col), id_col, lang_col, per_language)
    chosen = store(good.unionByName(bad.withColumn("_m", F.col("_m") + 2)), "kn-sample")
    length = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).alias("n")
    marks = chosen.small_side(64).toDF("i", "m")
    sizes = docs.select(F.col(id_col).alias("i"), length).join(marks, "i", "left")
    total, fitted = sizes.agg(*[F.coalesce(F.sum(x).cast("long"), F.lit(0)) for x in ("n", F.when(F.col("m").isNotNull(), F.col("n")))]).first()
    keep = keep or [id_col, lang_col]
    again = not {*keep} <= {id_col, lang_col}
    if fitted <= SENT_BYTES:
        texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
        sample = texts.join(marks, "i")
        models = fit_each(sample.select("t", "m"), 4, words_only=2, parts=-(-chosen.rows // TASK_DOCUMENTS) or None)
        sent = send(docs.sparkSession, models)
        whole = all(len(m.uni) for m in models[:2])
        scores = store(scored(docs, models, id_col, text_col, [id_col, lang_col], sent), "kn-scores").frame
        score = lambda columns: scored(docs, models, id_col, text_col, columns, sent)
    else:
        score, whole, drop = by_rounds(docs, chosen, id_col, text_col, list(dict.fromkeys([*keep, id_col, lang_col])), total)
        with _cleaned(docs.sparkSession):
            scores = _union([store(score([id_col, lang_col], part), "kn-scores") for part in range(SCORED)])
        if not again:
            drop()
    rows = {}
    if whole:
        limits = store(thresholds(trusted(scores, labels, id_col), lang_col, quantile, margin, prior), "kn-limits")
        # a row per language: read as a whole into an expression
        rows = {r.lang: (r.middle, r.threshold, *[r[c] for c in WINDOWS]) for r in limits.frame.collect()}
    nothing = (0.0, *[math.inf] * (1 + len(WINDOWS)))
    pooled = rows.pop(None, nothing)
    pair = lambda p: F.struct(*[F.lit(math.inf if x is None else float(x)).alias(c) for x, c in zip(p, ("middle", "threshold", *WINDOWS), strict=True)])
    by_lang = F.create_map(*[x for k, p in sorted(rows.items()) for x in (F.lit(k), pair(p))]) if rows else None
    lang = F.col(lang_col).cast("string")
    limit = F.when(lang.isNull(), pair(pooled)).otherwise(F.coalesce(by_lang[lang], pair(nothing)) if rows else pair(nothing))
    out = score(list(dict.fromkeys([*keep, lang_col]))) if again else scores
    out = out.withColumn("_limit", limit)
    rate = (-F.col("log10_prob") + F.col("_limit.middle") * prior) / (F.col("n_tokens") + prior)
    fine = F.coalesce(rate <= F.col("_limit.threshold"), F.lit(True))
    for c in WINDOWS:
        fine &= F.coalesce(F.col(c) <= F.col(f"_limit.{c}"), F.lit(True))
    return out.select(
        *keep, "n_tokens", "log10_prob", F.pow(F.lit(10.0), -F.col("log10_prob") / F.col("n_tokens")).alias("perplexity"),
        F.pow(F.lit(10.0), F.col("_limit.threshold")).alias("threshold"),
        *[x for c in WINDOWS for x in (F.col(c), F.col(f"_limit.{c}").alias(f"{c}_limit"))], fine.alias("kept"),
    )
