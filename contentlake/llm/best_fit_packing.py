"""Best-fit-decreasing packing of tokenized documents into sequences (operator 4).

A document's tokens are its ids followed by one end id. Documents longer than a sequence are cut into
pieces of the full length (the last may be shorter). Pieces are dealt to groups of about
``group_rows`` rows; inside a group they are taken from the longest to the shortest, and each goes
to the open sequence with the least room that still fits it. A segment tree over remaining
capacities (a leaf per capacity, a node tells whether any open sequence lies below it) finds that
sequence in logarithmic time. A group's last open sequences are all that separates this from one
packing of everything: under one sequence in a few hundred.

Token ids are made in Arrow batches. The tokenizer splits a text into words and encodes each word by
itself, so words are encoded once and kept in a table of at most ``CACHE`` words per Python worker;
a text with characters outside a plain Latin range goes through the tokenizer as a whole.

Defined results: null and empty texts hold only the end id; null document ids stay null; rows that
repeat are packed as often as they come. An empty table gives no pieces. The number of groups
follows from the table's length, and rows are dealt by a hash of their content and row number, so
neither copies nor a hot source meet in one group. The row number is that of the scan: give a stored
table, as the pipeline does, so that a lost task reads its rows in the same order again.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE = 500_000

# Letters, digits and white space of the Latin range, as the tokenizer's pattern sees them.
_LETTERS, _DIGITS, _BLANKS = r"a-zªµºß-öø-ÿ", r"0-9²³¹¼-¾", r"\t-\r \x85\xa0"
_PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_BLANKS}{_LETTERS}{_DIGITS}]+")
#: Texts that hold anything else are encoded as a whole.
_PLAIN = re.compile(r"[\t-\r -~\xa1-\xff]*")


class WordTokenizer:
    """Ids of a text as little-endian unsigned 32-bit bytes, exactly those of the tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.whole, self.single = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # A word that is lower-cased and split already needs neither of those steps again.
        self.single.normalizer = None
        self.single.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.words: dict[str, bytes] = {}

    @staticmethod
    def _bytes(tokenizer, texts: list[str]) -> list[bytes]:
        found = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in found]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.words) > CACHE:
            self.words = {}
        for t in texts:
            if "<|" in t or not _PLAIN.fullmatch(t):
                yield self._bytes(self.whole, [t])[0]
                continue
            found = _PRETOKEN.findall(t.lower())
            new = list(set(found).difference(self.words))
            if new:
                self.words.update(zip(new, self._bytes(self.single, new), strict=True))
            yield b"".join(map(self.words.__getitem__, found))


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 1,
             groups: int = 1, keep_ids: bool = False) -> DataFrame:
    """One row per piece: ``id, piece, start, length, ids_crc32, grp`` and, if asked for, ``ids``."""
    end = np.array([end_id], "<u4").tobytes()
    fields = [("id", docs.schema[id_col].dataType.simpleString()), ("piece", "int"), ("start", "bigint"), ("length", "bigint"),
              ("ids_crc32", "bigint"), ("grp", "bigint")] + [("ids", "binary")] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        for b in batches:
            out: list[list] = [[] for _ in fields]
            rows, grp = [], b.column("grp").to_pylist()
            for n, ids in enumerate(tok.encode([t or "" for t in b.column("t").to_pylist()])):
                ids += end
                for p in range(0, -(-len(ids) // (4 * capacity))):
                    part = ids[p * 4 * capacity:(p + 1) * 4 * capacity]
                    rows.append(n)
                    for c, v in zip(out[1:], (p, p * capacity, len(part) // 4, zlib.crc32(part), (grp[n] + p) % groups, part), strict=False):
                        c.append(v)
            kinds = [b.schema.field("id").type, pa.int32(), *[pa.int64()] * 4, pa.binary()]
            cols = [b.column("id").take(pa.array(rows, pa.int64()))] + [pa.array(c, k) for c, k in zip(out[1:], kinds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(cols, names=[f for f, _ in fields])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t"))
    rows = rows.select("id", "t", F.pmod(F.xxhash64("id", "t", F.monotonically_increasing_id()), F.lit(groups)).alias("grp"))
    return rows.mapInArrow(run, ", ".join(f"{f} {k}" for f, k in fields))


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(sequence, offset) of each length, for lengths from 1 to ``capacity`` in descending order."""
    size = 1 << (capacity + 1).bit_length()
    tree = bytearray(2 * size)  # tree[size + r]: some open sequence has r tokens of room
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    seqs, offsets, n = [], [], 0
    for x in lengths:
        i = size + x
        if not tree[i]:  # climb to the first sibling on the right that has an open sequence, then go down its left edge
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i > 1:
                i += 1
                while i < size:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
        if i > 1:
            room = i - size
            seq = open_at[room].pop()
            if not open_at[room]:
                tree[i] = 0
                while i > 1 and not (tree[i] or tree[i ^ 1]):
                    i >>= 1
                    tree[i] = 0
        else:
            room, seq, n = capacity, n, n + 1
        seqs.append(seq)
        offsets.append(capacity - room)
        left = room - x
        if left:
            open_at[left].append(seq)
            i = size + left
            while i and not tree[i]:
                tree[i] = 1
                i >>= 1
    return seqs, offsets


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 1,
         group_rows: int = 4096, keep_ids: bool = False) -> DataFrame:
    """One row per piece: ``<id_col>, piece, start, length, ids_crc32, sequence_id, offset`` and, with
    ``keep_ids``, ``ids`` (array of ints)."""
    groups = max(1, -(-docs.count() // group_rows))
    pieces = tokenize(docs, path, id_col, text, capacity, end_id, groups, keep_ids)

    def place(t: pa.Table) -> pa.Table:
        # Ids and checksums only settle ties, so that a repeated task packs alike.
        t = t.sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("id", "ascending"), ("piece", "ascending")])
        seqs, offsets = best_fit(t.column("length").to_pylist(), capacity)
        seqs = np.array(seqs, np.int64) + (t.column("grp").to_numpy() << 32)
        return t.drop_columns(["grp"]).append_column("sequence_id", pa.array(seqs)).append_column("offset", pa.array(offsets, pa.int64()))

    place.__annotations__ = {"t": pa.Table, "return": pa.Table}
    out = [f for f in pieces.schema if f.name != "grp"]
    packed = pieces.groupBy("grp").applyInArrow(place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out)
                                               + ", sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)
