"""Packing tokenised documents into fixed sequences: first-fit decreasing with a tournament tree of bin room.

A document is cut into pieces of the sequence length; full pieces are sequences of their own and the rests are packed.
Documents are dealt to randomised groups of a few thousand (a keyed hash, so a rerun deals alike), and every group is
packed alone: rests in order of falling length, each into the first open bin with room.  The tree's inner nodes hold the
largest room below them, so the first fitting bin is found in the logarithm of their number.

Only (id, start, length, checksum) leaves the tokenising tasks; texts are never shuffled.

Defined results: null or empty text is the end token alone; a null id stays null; rows that repeat an id are packed each,
and equal rows are dealt to different groups so that no group fills up with copies.
"""

from __future__ import annotations

import json
import math
import os
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from veilink.llm import chunks

LENGTH = 2048
END = 1
GROUP_DOCUMENTS = 8192
CACHED_WORDS, CACHED_PIECES = 150_000, 250_000
TOKENIZER = "word_bpe_49k.json"

# Fixed value: how the vocabulary splits lower-cased text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PARTS = regex.compile(SPLIT)
MARKS = string.punctuation
PLAIN = regex.compile(r"[!-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017E]*")


def _shown() -> list[str]:
    """The character that byte-level vocabularies show for each byte: itself where printable, else from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


SHOWN = _shown()

CUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces(dict):
    """Ids of the pieces that the vocabulary's splitting makes of a word, each worked out once."""

    def __init__(self, model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join(SHOWN[x] for x in piece.encode())
        found = [t.id for t in self.model.tokenize(shown)]
        ids = struct.pack(f"<{len(found)}I", *found)
        self[piece] = ids
        return ids


class Encoder(dict):
    """Token ids of words as little-endian bytes; a text's ids are those of its words in a row.

    The vocabulary's own rules never join what white space parts.  Words of plain characters (printable ASCII, Latin
    letters in one code point each) are lower-cased and split here and looked up piece by piece; any other word, and any
    vocabulary with other rules, goes to the library as it is.  Both memories are bounded.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules, split = (json.loads(x.__getstate__()) if x else {} for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer))
        # the splitting that the fast way repeats; special tokens in a text are the library's work
        self.known = (
            [n.get("type") for n in rules.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and [p.get("type") for p in split.get("pretokenizers", [])] == ["Split", "ByteLevel"]
            and split["pretokenizers"][0]["pattern"].get("Regex") == SPLIT
        )
        self.special = {t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.pieces = Pieces(self.tokenizer.model)

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        core = text.rstrip(MARKS)
        plain = self.known and (text.isascii() or PLAIN.fullmatch(text))
        if plain and core.isalpha():  # letters, then marks: two pieces at most
            ids = self.pieces[core.lower()] + (self.pieces[text[len(core) :]] if len(core) < len(text) else b"")
        elif plain and PLAIN.fullmatch(text) and not any(t in word for t in self.special):
            ids = b"".join(map(self.pieces.__getitem__, PARTS.findall(text.lower())))
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        if len(self) > CACHED_WORDS:
            self.clear()
        if len(self.pieces) > CACHED_PIECES:
            self.pieces.clear()
        return b"".join(map(self.__getitem__, text.split()))


class Room:
    """Tournament tree over the room left in bins; each inner node holds the larger room of its two children."""

    def __init__(self, most: int, length: int) -> None:
        self.size = 1 << max(0, (most - 1).bit_length())
        self.best = [length] * (2 * self.size)

    def place(self, need: int) -> tuple[int, int]:
        """Takes ``need`` from the first bin with that much room; (bin, room it had)."""
        best, at = self.best, 1
        while at < self.size:
            at *= 2
            if best[at] < need:
                at += 1
        had = best[at]
        best[at] = had - need
        bin_ = at - self.size
        while at > 1:
            at //= 2
            top = max(best[2 * at], best[2 * at + 1])
            if best[at] == top:
                break
            best[at] = top
        return bin_, had


def first_fit_decreasing(lengths: list[int], length: int = LENGTH) -> list[tuple[int, int]]:
    """(bin, offset) of every piece, the pieces being sorted by falling length."""
    tree = Room(max(1, len(lengths)), length)
    return [(b, length - had) for b, had in map(tree.place, lengths)]


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END,
    tokenizer: str | None = None, group_documents: int = GROUP_DOCUMENTS,
) -> DataFrame:
    """One row per piece: where it comes from and where it lies."""
    path = tokenizer or tokenizer_path()
    groups, last = max(1, math.ceil(docs.count() / group_documents)), np.array([end], "<u4").tobytes()
    cut_schema, packed_schema = chunks.arrow_schema(CUT), chunks.arrow_schema(PACKED)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, copies = Encoder(path), {}
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            for at in range(0, len(ids), 256):
                rows = []
                for doc, text in zip(ids[at : at + 256], texts.slice(at, 256).to_pylist(), strict=True):
                    tokens = encoder.encode(text or b"") + last
                    n, whole = len(tokens) // 4, zlib.crc32(tokens)
                    copy = copies.get((doc, whole), 0)
                    copies[doc, whole] = copy + 1
                    part = zlib.crc32(f"{doc} {whole} {copy}".encode()) % groups
                    for start in range(0, n, length):
                        data = tokens[4 * start : 4 * (start + length)]
                        rows.append((doc, start, len(data) // 4, zlib.crc32(data), n, part))
                if len(copies) > 1_000_000:
                    copies = {}
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), cut_schema.types)], schema=cut_schema)

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        part = table["part"][0].as_py()
        placed = first_fit_decreasing(table["length"].to_pylist(), length)
        bins, offsets = np.array([b for b, _ in placed], np.int64), np.array([o for _, o in placed], np.int64)
        table = table.drop_columns("part").append_column("sequence_id", pa.array((part << 32) + bins))
        return table.append_column("offset", pa.array(offsets)).cast(packed_schema)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(chunks.tidy(cut), CUT).groupBy("part").applyInArrow(fill, PACKED)
