"""Questions to the whole corpus from compact tables of chunks.

Documents are written once as *chunks*: rows of a few MB of compressed text with a number that stays.
A level of an operator asks, for 64-bit names of pieces of its chunk, what the corpus knows about them:

    chunks --keys--> (chunk, key range, sorted distinct keys) --by range--> one byte per key --by chunk--> chunks

A chunk sends each name once however often it holds it, so a passage that half the corpus shares adds one entry
per chunk to its range.  Ranges are as many as keep a range within one task; answers return in the order asked.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from veilink.llm import words
from veilink.sources.store import Stored, store

CHUNK_BYTES = 3 << 20
RANGE_KEYS = 2_000_000
NO_ID = 2**63 - 1

CHUNK_SCHEMA = "chunk long, ids array<long>, sizes array<int>, data binary, alive binary, rest array<string>"
KEY_SCHEMA = "chunk long, range int, n int, keys binary, owner binary"
ANSWER_SCHEMA = "chunk long, range int, answer binary"


def give_back() -> None:
    """Returns freed memory to the system, as a worker lives on after its task and the executor's other parts need the room."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``work`` of ``mapInArrow``, with what it held given back when its task is over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # a task that was cut short left before its end
        yield from work(batches)
        give_back()

    return run


def squeeze(data: bytes | np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(memoryview(data) if isinstance(data, np.ndarray) else data)


def loosen(data: bytes, dtype: str = "uint8") -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def planes(values: np.ndarray) -> bytes:
    """Integers by byte planes: the high bytes of small differences are runs of zeros."""
    return squeeze(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).ravel()) if len(values) else b""


def unplanes(data: bytes, n: int, dtype: str) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype)
    return np.ascontiguousarray(loosen(data).reshape(-1, n).T).ravel().view(dtype)


@dataclass
class Chunk:
    """One chunk in memory; ``alive`` is the level's own mask, None at the first level."""

    number: int
    ids: np.ndarray
    offsets: np.ndarray
    data: np.ndarray
    alive: np.ndarray | None
    rest: list | None = None

    @classmethod
    def read(cls, row: dict) -> "Chunk":
        sizes = np.asarray(row["sizes"], np.int64)
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        alive = row.get("alive")
        mask = None if alive is None else np.unpackbits(loosen(alive)).astype(bool)
        return cls(row["chunk"], np.asarray(row["ids"], np.int64), offsets, loosen(row["data"]), mask, row.get("rest"))

    def row(self) -> dict:
        return {
            "chunk": self.number,
            "ids": self.ids.tolist(),
            "sizes": np.diff(self.offsets).tolist(),
            "data": squeeze(self.data),
            "alive": None if self.alive is None else squeeze(np.packbits(self.alive)),
            "rest": self.rest,
        }

    def runs(self, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Bytes, offsets and first place of successive documents: pieces that stay in the processor's cache."""
        for lo, hi in document_runs(self.offsets, most):
            at = self.offsets[lo]
            yield self.data[at : self.offsets[hi]], self.offsets[lo : hi + 1] - at, int(at)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def document_runs(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Successive ranges of documents of at most ``most`` bytes together, or of one longer document."""
    begin, n = 0, len(offsets) - 1
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1)
        yield begin, min(end, n)
        begin = end


def keep_documents(chunk: Chunk, keep: np.ndarray, place_bounds: np.ndarray, alive: np.ndarray) -> Chunk:
    """The chunk with the kept documents only; ``place_bounds`` says where each one's places begin in ``alive``."""
    sizes = np.diff(chunk.offsets)
    data = chunk.data[np.repeat(keep, sizes)]
    mask = alive[np.repeat(keep, np.diff(place_bounds))]
    rest = chunk.rest and [chunk.rest[i] for i in np.flatnonzero(keep)]
    return Chunk(chunk.number, chunk.ids[keep], np.concatenate(([0], np.cumsum(sizes[keep]))), data, mask, rest)


def batch_of(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow types of the few column types used here."""
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(),
        "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "boolean": pa.bool_(),
        "array<float>": pa.list_(pa.float32()), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()),
    }
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


def write_chunks(docs: DataFrame, id_col: str, text_col: str, label: str, rest: Column | None = None) -> Stored:
    """Texts in a table of chunks, with the figure ``bytes``.  A null text is empty, a null id sorts last.

    ``rest`` is a text that travels with each document.
    """
    out_schema, carries = arrow_schema(CHUNK_SCHEMA), rest is not None

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        runs: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        more: list[str] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, runs, sizes, more, held, count
            id_of, size_of, data = np.concatenate(ids), np.concatenate(sizes), np.concatenate(runs)
            starts = np.concatenate(([0], np.cumsum(size_of)))[:-1]
            order = np.argsort(id_of, kind="stable")
            data = np.concatenate([data[starts[i] : starts[i] + size_of[i]] for i in order]) if len(data) else data
            bounds = np.concatenate(([0], np.cumsum(size_of[order])))
            chunk = Chunk(part << 32 | count, id_of[order], bounds, data, None, [more[i] for i in order] if more else None)
            ids, runs, sizes, more, held, count = [], [], [], [], 0, count + 1
            return batch_of([chunk.row()], out_schema)

        for batch in batches:
            id_of = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            data, offsets = words.arrow_run(batch.column(1))
            begin = 0
            while begin < len(id_of):
                end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + CHUNK_BYTES - held, "right")) - 1)
                ids.append(id_of[begin:end])
                sizes.append(np.diff(offsets[begin : end + 1]))
                runs.append(data[offsets[begin] : offsets[end]].copy())
                if carries:
                    more += batch.column(2).slice(begin, end - begin).to_pylist()
                held += int(offsets[end] - offsets[begin])
                begin = end
                if held >= CHUNK_BYTES * 9 // 10:
                    yield flush()
        if ids:
            yield flush()

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *([] if rest is None else [rest.alias("rest")]))
    bytes_of = F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))
    return store(slim.mapInArrow(tidy(pack), CHUNK_SCHEMA), label, bytes=F.coalesce(bytes_of, F.lit(0).cast("long")))


def range_bits(keys: float) -> int:
    """So many leading bits number the key ranges that none holds much more than RANGE_KEYS keys."""
    return max(4, math.ceil(math.log2(max(1.0, keys / RANGE_KEYS))))


def key_rows(number: int, keys: np.ndarray, bits: int, width: int, owners: np.ndarray | None = None) -> list[dict]:
    """Rows that carry sorted distinct keys to their ranges.

    ``width`` bytes of the key follow the range number: 4 for filters that a later level checks, 6 for the last
    word (with ten range bits a wrong hit then needs some 10^17 distinct pieces).
    """
    lead = (keys >> np.uint64(64 - bits)).astype(np.int64)
    present, begins = np.unique(lead, return_index=True)
    begins = np.append(begins, len(keys))
    rest = keys << np.uint64(bits)
    values = rest >> np.uint64(64 - 8 * width)
    values = values.astype(np.uint32) if width == 4 else values
    rows = []
    for r, lo, hi in zip(present.tolist(), begins[:-1], begins[1:], strict=True):
        part = values[lo:hi]
        steps = np.concatenate((part[:1], np.diff(part)))
        rows.append({
            "chunk": number, "range": r, "n": int(hi - lo), "keys": planes(steps),
            "owner": None if owners is None else planes(owners[lo:hi]),
        })
    return rows


def ask(chunks: DataFrame, keys_of: Callable[[Chunk], tuple], bits: int, width: int, answer: Callable, kind: str = "uint8", also: Callable | None = None) -> DataFrame:
    """One round: ``keys_of(chunk)`` gives (sorted distinct keys, a long each or None) and ``answer`` one value per key.

    ``answer(group, count, chunk_of, owner_of)`` sees one range: ``group`` numbers the distinct keys, ``count`` their
    entries, the other two the asking chunk and the long sent with each entry.  ``also(range, distinct keys, group,
    owner_of)`` may add bytes about the range as a whole, in a row of chunk -1.
    """
    key_schema, answer_schema = arrow_schema(KEY_SCHEMA), arrow_schema(ANSWER_SCHEMA)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = Chunk.read(batch.slice(i, 1).to_pylist()[0])
                rows = key_rows(chunk.number, *_split(keys_of(chunk), bits, width))
                if rows:
                    yield batch_of(rows, key_schema)

    def _split(found, bits, width):
        keys, owners = found
        return keys, bits, width, owners

    def settle(table: pa.Table) -> pa.Table:
        give_back()  # what the group before it held
        rows = table.to_pylist()
        dtype = "uint32" if width == 4 else "uint64"
        keys = np.concatenate([np.cumsum(unplanes(r["keys"], r["n"], dtype), dtype=dtype) for r in rows])
        sizes = np.array([r["n"] for r in rows])
        found, group, count = np.unique(keys, return_inverse=True, return_counts=True)
        chunk_of = np.repeat(np.array([r["chunk"] for r in rows], np.int64), sizes)
        owner_of = None
        if rows[0]["owner"] is not None:
            owner_of = np.concatenate([unplanes(r["owner"], r["n"], "int64") for r in rows])
        said = answer(group, count, chunk_of, owner_of).astype(kind)
        cut = np.split(said, np.cumsum(sizes)[:-1])
        out = [{"chunk": r["chunk"], "range": r["range"], "answer": planes(a)} for r, a in zip(rows, cut, strict=True)]
        if also:
            out.append({"chunk": -1, "range": rows[0]["range"], "answer": also(rows[0]["range"], found, group, owner_of)})
        return pa.Table.from_pylist(out, schema=answer_schema)

    spread_out = chunks.mapInArrow(tidy(spread), KEY_SCHEMA)
    return spread_out.groupBy("range").applyInArrow(settle, ANSWER_SCHEMA)


def told(
    chunks: DataFrame, answers: DataFrame, use: Callable[[Chunk, np.ndarray], list[dict]], schema: str, kind: str = "uint8"
) -> DataFrame:
    """Brings the answers of a round back to their chunks: ``use(chunk, answers in key order)`` makes the rows."""
    out_schema = arrow_schema(schema)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_pylist([], schema=out_schema)
        give_back()
        rows = sorted(right.to_pylist(), key=lambda r: r["range"])
        wide = np.dtype(kind).itemsize
        parts = [loosen(r["answer"]) for r in rows]
        said = np.concatenate([np.ascontiguousarray(p.reshape(wide, -1).T).ravel().view(kind) for p in parts] or [np.zeros(0, kind)])
        return pa.Table.from_pylist(use(Chunk.read(left.to_pylist()[0]), said), schema=out_schema)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(meet, schema)


def repeated(group: np.ndarray, count: np.ndarray, chunk_of: np.ndarray, owner_of) -> np.ndarray:
    """Answer: 1 where another chunk asks about the same key."""
    return (count > 1)[group]


def first_owner(group: np.ndarray, count: np.ndarray, chunk_of: np.ndarray, owner_of: np.ndarray) -> np.ndarray:
    """Answer: 1 for the entry of each key with the smallest owner id (then chunk), 0 for the others."""
    order = np.lexsort((chunk_of, owner_of, group))
    lead = np.ones(len(order), bool)
    lead[1:] = np.diff(group[order]) > 0
    said = np.zeros(len(order), np.uint8)
    said[order[lead]] = 1
    return said
