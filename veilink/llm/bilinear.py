"""Log-bilinear language model, trained in numpy by noise-contrastive estimation.

Vocabulary: the end mark, one entry for rarer words, and the most frequent training words, ``growth`` for each unit of the
cube root of the number of training words, so it grows with the corpus (some 2,000 at 0.5 million words, 36,000 at 3.6
billion).  Words are dealt to classes by frequency rank, about as many classes as words in one.  After the tokens h1, h2

    x = c_1 * r(h1) + c_2 * r(h2)
    p(w | h1 h2) = softmax over classes(x . s + a)[class of w]  x  softmax over the class(x . q + b)[w]

as matrix products per slice of tokens, normalised in both factors.  The end mark and the rarer words are classes of one
entry; a rarer word has that entry's probability times its own share in it, (c + 0.5) / (n + 0.5 (v + 1)) with the corpus
counts, so the model is normalised over all words, unseen ones together counting as one.

1. One round over chunks counts every token of the training documents over the whole corpus; every chunk learns the
   counts of its words and turns its texts into token numbers.
2. A training pass has ``ROUNDS`` rounds.  A training document belongs to one round and one share of it by a hash of its
   id and tokens.  Each share starts from the current parameters and goes once through its documents in the order of the
   hash (data against noise samples, Adagrad); the results are averaged in Spark, weighted by tokens.  Neither shares nor
   their order depend on how the input is partitioned; only rows that repeat both id and text are dealt by their place.
   The number of shares grows with the square root of the tokens, so work per share and bytes averaged stay in balance.
3. Every document is scored.

The parameters take 65 numbers for each word of the vocabulary, which the cube root bounds (170 MB at 20 trillion words);
they are sent to every task.  Counts and texts stay where they are.

Defined results: null or empty text is the end mark alone; a null id counts as the empty text for the split; rows that
repeat an id are scored each; without training documents the base is 0 and the model's parameters stay at their start.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veilink.llm import chunks, words
from veilink.llm.chunks import Chunk
from veilink.sources.store import store

END, RARE = 0, 1
GROWTH = 24
DIM = 32
BATCH, NOISE, OWN_NOISE, RATE = 2048, 32, 4, 0.05
ROUNDS, SHARE_TOKENS, PIECE = 4, 1 << 20, 1 << 18
SLICE_NUMBERS = 1 << 22

TOKENS = "part long, ids array<long>, sizes array<int>, tokens binary, rare array<double>, known array<long>, base array<double>"
SHARES = "share int, key long, id long, tokens binary"
BLOCKS = "block int, share int, weight double, numbers binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def held_out(doc_id: int) -> bool:
    text = b"" if doc_id == chunks.NO_ID else str(doc_id).encode()
    return zlib.crc32(text) % 5 == 1


def classes(size: int) -> np.ndarray:
    """Where each class begins among the ``size`` entries, and the end: one entry each for END and RARE, then equal widths."""
    width = max(1, math.ceil(math.sqrt(size)))
    return np.concatenate(([END, RARE], np.arange(2, size, width), [size]))


def _log_softmax(x: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """The named numbers of the log-softmax of each row; ``x`` is used up."""
    x -= x.max(axis=1, keepdims=True)
    picked = x[row, column].astype(np.float64)
    return picked - np.log(np.exp(x, out=x) @ np.ones(x.shape[1], x.dtype))[row]


class Model:
    """Parameters in one flat array: contexts r, targets q, biases b, classes s with biases a, position weights c."""

    def __init__(self, size: int, flat: np.ndarray) -> None:
        self.size, self.flat = size, flat
        self.begins = classes(size)
        self.of = np.repeat(np.arange(len(self.begins) - 1), np.diff(self.begins))
        n = len(self.begins) - 1
        cut = np.split(flat, np.cumsum([size * DIM, size * DIM, size, n * DIM, n]))
        self.r, self.q, self.s, self.c = (cut[i].reshape(-1, DIM) for i in (0, 1, 3, 5))
        self.b, self.a = cut[2], cut[4]

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 5) -> "Model":
        """Small random vectors, biases at the shares of the counts."""
        size, rng = len(counts), np.random.default_rng(seed)
        of_class, within = shares(counts)
        vectors = rng.normal(0, 0.1, (2 * size + len(of_class)) * DIM)
        parts = [vectors[: 2 * size * DIM], np.log(within), vectors[2 * size * DIM :], np.log(of_class), np.ones(2 * DIM)]
        return cls(size, np.concatenate(parts).astype(np.float32))

    def hidden(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.r[one] * self.c[0] + self.r[two] * self.c[1]

    def log_prob(self, w: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Normalised log-probability of every token ``w`` after the tokens ``one`` and, before that, ``two``."""
        out = np.empty(len(w))
        step = max(1, SLICE_NUMBERS // len(self.a))
        for at in range(0, len(w), step):
            here = w[at : at + step].astype(np.int64)
            after = one[at : at + step].astype(np.int64) * self.size + two[at : at + step]
            pairs, inverse = np.unique(after, return_inverse=True)
            x = self.hidden(pairs // self.size, pairs % self.size)
            of = self.of[here]
            logs = _log_softmax(x @ self.s.T + self.a, inverse, of)
            order = np.argsort(of, kind="stable")
            edges = np.searchsorted(of[order], np.arange(len(self.begins)))
            for k in np.unique(of[of > RARE]):
                which, lo, hi = order[edges[k] : edges[k + 1]], self.begins[k], self.begins[k + 1]
                logs[which] += _log_softmax(x.take(inverse[which], axis=0) @ self.q[lo:hi].T + self.b[lo:hi], np.arange(len(which)), here[which] - lo)
            out[at : at + step] = logs
        return out


def shares(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The share of every class, and of every entry in its class."""
    begins = classes(len(counts))
    smooth = counts + 0.5
    total = np.add.reduceat(smooth, begins[:-1])
    return total / total.sum(), smooth / np.repeat(total, np.diff(begins))


def contexts(tokens: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before and the one before that; before a document stand end marks."""
    one, two = np.zeros_like(tokens), np.zeros_like(tokens)
    one[1:], two[2:] = tokens[:-1], tokens[:-2]
    one[begins] = END
    two[begins] = END
    later = begins + 1
    two[later[later < len(tokens)]] = END
    return one, two


def _grouped(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that puts equal numbers below ``size`` together, where each begins in it, and the numbers."""
    order = np.argsort(at.astype(np.uint16 if size <= 1 << 16 else np.uint32), kind="stable")  # short ones sort faster
    at = at[order]
    begins = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return order, begins, at[begins]


def _add_rows(to: np.ndarray, seen: np.ndarray, which: np.ndarray, step: np.ndarray) -> None:
    """One Adagrad step for the rows of ``to`` named in ``which``."""
    sums = seen.take(which, axis=0) + step * step
    seen[which] = sums
    to[which] = to.take(which, axis=0) + RATE * step / np.sqrt(sums + 1e-6)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(model: Model, memory: Model, tokens: np.ndarray, begins: np.ndarray, counts: np.ndarray, rng) -> None:
    """One pass of noise-contrastive estimation: classes against NOISE samples shared by a batch, words against OWN_NOISE of their class."""
    one, two = contexts(tokens, begins)
    of_class, within = shares(counts)
    class_prior, prior = np.log(NOISE * of_class).astype(np.float32), np.log(OWN_NOISE * within).astype(np.float32)
    class_edges = np.cumsum(of_class)
    edges = np.concatenate(([0.0], np.cumsum(counts + 0.5)))
    for at in range(0, len(tokens), BATCH):
        w, h1, h2 = tokens[at : at + BATCH], one[at : at + BATCH], two[at : at + BATCH]
        r1, r2, of = model.r.take(h1, axis=0), model.r.take(h2, axis=0), model.of[w]
        x = r1 * model.c[0] + r2 * model.c[1]
        # the class
        drawn = np.minimum(np.searchsorted(class_edges, rng.random(NOISE) * class_edges[-1]), len(of_class) - 1)
        up = _sigmoid(class_prior[of] - np.einsum("ij,ij->i", x, model.s[of]) - model.a[of])
        down = -_sigmoid(x @ model.s[drawn].T + (model.a[drawn] - class_prior[drawn]))
        dx = up[:, None] * model.s[of] + down @ model.s[drawn]
        ds = np.concatenate((up[:, None] * x, down.T @ x))
        da = np.concatenate((up, down.sum(axis=0)))
        order, first, aims = _grouped(np.concatenate((of, drawn)), len(of_class))
        ds, da = np.add.reduceat(ds.take(order, axis=0), first), np.add.reduceat(da[order], first)
        # the word in its class
        inner = np.flatnonzero(of > RARE)
        lo, hi = edges[model.begins[of[inner]]], edges[model.begins[of[inner] + 1]]
        own = np.searchsorted(edges, lo[:, None] + rng.random((len(inner), OWN_NOISE)) * (hi - lo)[:, None], side="right") - 1
        own = np.clip(own, model.begins[of[inner]][:, None], model.begins[of[inner] + 1][:, None] - 1)
        both = np.concatenate((w[inner][:, None], own), axis=1)
        q, inside = model.q.take(both, axis=0), x.take(inner, axis=0)
        push = -_sigmoid(np.einsum("ikj,ij->ik", q, inside) + model.b.take(both) - prior.take(both))
        push[:, 0] += 1
        dx[inner] += np.einsum("ik,ikj->ij", push, q)
        dc = np.stack(((dx * r1).sum(axis=0), (dx * r2).sum(axis=0)))
        _add_rows(model.s, memory.s, aims, ds)
        _add_rows(model.a, memory.a, aims, da)
        if len(inner):
            order, first, words_of = _grouped(both.ravel(), model.size)
            push = push.ravel()[order]
            _add_rows(model.q, memory.q, words_of, np.add.reduceat(inside.take(order // (1 + OWN_NOISE), axis=0) * push[:, None], first))
            _add_rows(model.b, memory.b, words_of, np.add.reduceat(push, first))
        order, first, before = _grouped(np.concatenate((h1, h2)), model.size)
        later = order >= len(w)
        dr = dx.take(order - len(w) * later, axis=0) * model.c.take(later.astype(np.int64), axis=0)
        _add_rows(model.r, memory.r, before, np.add.reduceat(dr, first))
        memory.c += dc * dc
        model.c += RATE * dc / np.sqrt(memory.c + 1e-6)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _averaged(trained: DataFrame, length: int) -> np.ndarray:
    """Token-weighted mean of the shares' parameters, block by block; empty if nothing was trained."""
    ddl = "block int, weight double, numbers binary"

    def add(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["share"])
        weight = sum(r["weight"] for r in rows)
        total = sum(np.frombuffer(r["numbers"], np.float32) * r["weight"] for r in rows)
        mean = (total / weight).astype(np.float32)
        return pa.Table.from_pylist([{"block": rows[0]["block"], "weight": weight, "numbers": mean.tobytes()}], schema=chunks.arrow_schema(ddl))

    # as long as the parameters
    rows = trained.groupBy("block").applyInArrow(add, ddl).orderBy("block").collect()
    return np.concatenate([np.frombuffer(r.numbers, np.float32) for r in rows])[:length] if rows else np.zeros(0, np.float32)


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", growth: float = GROWTH, passes: int = 1
) -> DataFrame:
    """One row per document with the unigram base and the model's log10 probability of its whole text."""
    base = chunks.write_chunks(docs, id_col, text_col, "lm")
    bits = chunks.range_bits(base.seen["bytes"] / 20)
    cut = np.uint64(64 - bits - 48)
    most = math.floor(growth * base.seen["bytes"] ** (1 / 3))  # no more words than bytes

    def named(chunk: Chunk):
        first, last, bounds = words.word_spans(chunk.data, chunk.offsets)
        names = words.word_names(chunk.data, first, last, fold_case=True)
        found, inverse = np.unique(names, return_inverse=True)
        return found, inverse, bounds

    def keys_of(chunk: Chunk):
        found, inverse, bounds = named(chunk)
        training = np.repeat([not held_out(i) for i in chunk.ids.tolist()], np.diff(bounds))
        return found, np.bincount(inverse[training], minlength=len(found)).astype(np.int64)

    def sums(group: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return np.bincount(group, weights=owner).astype(np.int64)

    def frequent(number: int, found: np.ndarray, group: np.ndarray, owner: np.ndarray) -> bytes:
        """[words, distinct words, (name, count) of the most frequent] of one range."""
        count = sums(group, owner)
        top = np.lexsort((found, -count))[:most]
        top = top[count[top] > 0]
        names = (found[top].astype(np.uint64) + (np.uint64(number) << np.uint64(48))).view(np.int64)
        return np.concatenate(([count.sum(), (count > 0).sum()], np.stack((names, count[top])).T.ravel())).astype(np.int64).tobytes()

    answers = store(
        chunks.ask(base.frame, keys_of, bits, 6, lambda g, n, c, o: sums(g, o)[g], "int64", frequent), "lm-counts"
    ).frame
    about = answers.where("chunk = -1").select("answer")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            told = np.frombuffer(row["answer"], np.int64)
            n = (len(told) - 2) // 2
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[told[0], np.zeros(n, np.int64)]), pa.array(np.r_[told[1], np.zeros(n, np.int64)]), pa.array(np.r_[0, told[2::2]]), pa.array(np.r_[0, told[3::2]])], names=["total", "kinds", "name", "count"])

    facts = store(about.mapInArrow(spread, "total long, kinds long, name long, count long"), "lm-frequent").frame
    sizes = facts.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("v")).first()
    vocabulary = math.floor(growth * sizes.n ** (1 / 3))
    best = facts.where("count > 0").orderBy(F.desc("count"), "name").limit(vocabulary).collect()
    each = base.frame.select(F.explode("ids").alias("i"))
    text = F.when(F.col("i") == chunks.NO_ID, F.lit("")).otherwise(F.col("i").cast("string"))
    ends = each.where(F.crc32(text) % 5 != 1).count()
    n, v = sizes.n + ends, sizes.v + (ends > 0)
    top = np.array([r.name for r in best], np.int64)
    top_counts = np.array([r["count"] for r in best], np.int64)
    order = np.argsort(top)
    top, top_rank = top[order], (order + 2).astype(np.uint32)
    rare_n, rare_v = sizes.n - int(top_counts.sum()), sizes.v - len(best)
    counts = np.concatenate(([ends, rare_n], top_counts)).astype(np.float64)

    def number(chunk: Chunk, said: np.ndarray) -> list[dict]:
        found, inverse, bounds = named(chunk)
        short = (found >> cut).view(np.int64)
        kind = np.full(len(found), RARE, np.uint32)
        if len(top) and len(found):
            spot = np.minimum(np.searchsorted(top, short), len(top) - 1)
            hit = top[spot] == short
            kind[hit] = top_rank[spot[hit]]
        lengths = np.diff(bounds) + 1
        total = int(lengths.sum())
        at_end = np.cumsum(lengths) - 1
        inner = np.ones(total, bool)
        inner[at_end] = False
        tokens = np.zeros(total, np.uint32)
        tokens[inner] = kind[inverse]
        count = np.full(total, ends, np.int64)
        count[inner] = said[inverse] if len(found) else 0
        begins = at_end + 1 - lengths
        plain = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
        within = np.where(tokens == RARE, np.log10((count + 0.5) / (rare_n + 0.5 * (rare_v + 1))), 0.0)
        return [{
            "part": chunk.number, "ids": chunk.ids.tolist(), "sizes": lengths.tolist(), "tokens": chunks.squeeze(tokens),
            "rare": np.add.reduceat(within, begins).tolist(), "known": np.add.reduceat((count > 0).astype(np.int64), begins).tolist(),
            "base": np.add.reduceat(plain, begins).tolist(),
        }]

    numbered = store(chunks.told(base.frame, answers.where("chunk >= 0"), number, TOKENS, "int64"), "lm-tokens").frame
    base.drop()
    flat, size, block = Model.start(counts).flat, len(counts), 1024
    per_round = max(1, math.ceil(math.sqrt(n / SHARE_TOKENS)))

    def dealt(turn: int):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows_of(batches):
                texts = np.split(chunks.loosen(row["tokens"], "uint32"), np.cumsum(row["sizes"])[:-1])
                seen, out = Counter(), []
                for i, tokens in zip(row["ids"], texts, strict=True):
                    if held_out(i):
                        continue
                    told = hashlib.blake2b(tokens.tobytes(), digest_size=8, key=i.to_bytes(8, "little", signed=True)).digest()
                    seen[told] += 1
                    if seen[told] > 1:
                        told = hashlib.blake2b(told, digest_size=8, key=seen[told].to_bytes(8, "little")).digest()
                    key = int.from_bytes(told, "little") >> 1
                    if key % ROUNDS == turn:
                        out.append({"share": key // ROUNDS % per_round, "key": key, "id": i, "tokens": tokens.tobytes()})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=chunks.arrow_schema(SHARES))

        return work

    def trainer(flat: np.ndarray, turn: int):
        def sent(share: int, model: Model, weight: int) -> pa.RecordBatch:
            cut = range(0, len(model.flat), block)
            rows = [{"block": b // block, "share": share, "weight": float(weight), "numbers": model.flat[b : b + block].tobytes()} for b in cut]
            return pa.RecordBatch.from_pylist(rows, schema=chunks.arrow_schema(BLOCKS))

        def learn(model: Model, memory: Model, texts: list[bytes], seed: list[int]) -> int:
            lengths = np.array([len(t) // 4 for t in texts])
            train(model, memory, np.frombuffer(b"".join(texts), np.uint32), np.cumsum(lengths) - lengths, counts, np.random.default_rng(seed))
            return int(lengths.sum())

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            share, weight, pieces, texts, held = -1, 0, 0, [], 0
            model = memory = None
            for batch in batches:
                for of, tokens in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if texts and (of != share or held >= PIECE):
                        weight += learn(model, memory, texts, [turn, share, pieces])
                        texts, held, pieces = [], 0, pieces + 1
                    if of != share:
                        if weight:
                            yield sent(share, model, weight)
                        share, weight, pieces = of, 0, 0
                        model, memory = Model(size, flat.copy()), Model(size, np.zeros_like(flat))
                    texts.append(tokens.as_py())
                    held += len(texts[-1]) // 4
            if texts:
                weight += learn(model, memory, texts, [turn, share, pieces])
                yield sent(share, model, weight)

        return work

    for turn in range(passes * ROUNDS):
        rows = numbered.select("ids", "sizes", "tokens").mapInArrow(dealt(turn % ROUNDS), SHARES)
        ordered = rows.repartitionById(per_round, F.col("share")).sortWithinPartitions("share", "key", "id", "tokens").select("share", "tokens")
        mean = _averaged(ordered.mapInArrow(trainer(flat, turn), BLOCKS), len(flat))
        flat = mean if len(mean) else flat

    out_schema = chunks.arrow_schema(SCORES)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(size, flat)
        for row in _rows_of(batches):
            lengths = np.array(row["sizes"])
            tokens = chunks.loosen(row["tokens"], "uint32")
            begins = np.cumsum(lengths) - lengths
            one, two = contexts(tokens, begins)
            logs = model.log_prob(tokens, one, two)
            total = np.add.reduceat(logs, begins) / np.log(10) + np.array(row["rare"])
            ids = row["ids"]
            yield pa.RecordBatch.from_arrays([
                pa.array([None if i == chunks.NO_ID else i for i in ids], pa.int64()), pa.array([held_out(i) for i in ids]),
                pa.array(lengths, pa.int64()), pa.array(row["known"], pa.int64()), pa.array(row["base"]), pa.array(total),
            ], schema=out_schema)

    return numbered.mapInArrow(judge, SCORES).withColumn("train_tokens", F.lit(n).cast("long"))
