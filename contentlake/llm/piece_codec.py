"""SentencePiece encoding and decoding for merge-type vocabularies (operator 10).

A text gets the dummy prefix, blanks become the piece mark, and every character starts as a symbol.
An agenda holds all adjacent pairs of symbols that together are a piece, ordered by the piece's
score, then by place from the left; the best pair is merged, and the pairs it makes with its
neighbours join the agenda; entries whose symbols have changed meanwhile are skipped. Symbols that
are no piece at the end become their UTF-8 bytes' pieces.

No piece spans certain neighbours (a letter and a comma, say): characters are grouped into classes
by the pieces themselves, and a text is cut wherever two neighbours can never meet in a piece. The
segments are encoded one by one, and a table of at most ``CACHE`` segments per Python worker saves
repeating them. A vocabulary with the mark inside pieces is not cut at all.

Each Arrow batch is checked against the sentencepiece library: a text whose ids differ would get
the library's ids and ``agreed`` false. Decoding is the library's.

Defined results: null and empty texts have the end id only and decode to the empty text. Rows
repeat as given; added columns never replace a column of the input.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain, repeat
from operator import concat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE = 1_000_000
MARK = "▁"
#: Up to this length a list is the faster agenda; longer segments use a heap.
SHORT = 24
NEVER = float("inf")


def segment_pattern(pieces: list[str]) -> re.Pattern | None:
    """Cuts between characters of different classes; None if the mark stands inside a piece."""
    parent: dict[str, str] = {}

    def root(c: str) -> str:
        while parent.setdefault(c, c) != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    for p in pieces:
        body = p.lstrip(MARK)
        if MARK in body:
            return None
        for a, b in zip(body, body[1:], strict=False):
            parent[root(a)] = root(b)
    classes: dict[str, list[str]] = {}
    for c in list(parent):
        classes.setdefault(root(c), []).append(c)
    # The two largest classes (letters and punctuation, as a rule) have runs of their own; the rest is not cut.
    large = ["".join(map(re.escape, sorted(cs))) for cs in sorted(classes.values(), key=len, reverse=True)[:2]]
    runs = "".join(f"[{c}]+|" for c in large)
    return re.compile(f"{MARK}*(?:{runs}[^{MARK}{''.join(large)}]+)|{MARK}+", re.DOTALL)


class _Known(dict):
    """Segment -> ids; a segment is encoded when it is first asked for."""

    def __init__(self, codec: PieceCodec):
        self.codec = codec

    def __missing__(self, text: str) -> tuple[int, ...]:
        ids = self[text] = self.codec.segment(text)
        return ids


class PieceCodec:
    """Encoder and decoder for one model file."""

    def __init__(self, path: str):
        import sentencepiece
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end = sp.eos_id()
        normal = [i for i in range(sp.get_piece_size())
                  if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in normal}
        self.order = {sp.id_to_piece(i): -sp.get_score(i) for i in normal}  # the agenda's least comes first
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.pattern = segment_pattern(list(self.ids))
        self.known = _Known(self)
        self.decimal = [str(i) for i in range(sp.get_piece_size())]

    def merge_short(self, text: str) -> list[str]:
        """As ``merge``, with the agenda as a plain list in order of place: its first least entry is next."""
        syms, score = list(text), self.order.get
        agenda = list(map(score, map(concat, text, text[1:]), repeat(NEVER)))
        while agenda and (least := min(agenda)) < NEVER:
            i = agenda.index(least)
            syms[i:i + 2] = [syms[i] + syms[i + 1]]
            del agenda[i]
            if i:
                agenda[i - 1] = score(syms[i - 1] + syms[i], NEVER)
            if i < len(agenda):
                agenda[i] = score(syms[i] + syms[i + 1], NEVER)
        return syms

    def merge(self, text: str) -> list[str]:
        """Symbols of a segment after all merges."""
        if len(text) <= SHORT:
            return self.merge_short(text)
        syms: list[str] = list(text)
        n, order = len(syms), self.order
        agenda = [(s, i, i + 1, p) for i in range(n - 1) if (s := order.get(p := syms[i] + syms[i + 1])) is not None]
        if not agenda:
            return syms
        heapq.heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            _, i, j, piece = heapq.heappop(agenda)
            if not syms[i] or not syms[j] or len(syms[i]) + len(syms[j]) != len(piece):
                continue
            syms[i], syms[j] = piece, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (s := order.get(p := piece + syms[k])) is not None:
                    heapq.heappush(agenda, (s, i, k, p))
            h = before[i]
            if h >= 0 and (s := order.get(p := syms[h] + piece)) is not None:
                heapq.heappush(agenda, (s, h, i, p))
        return [s for s in syms if s]

    def segment(self, text: str) -> tuple[int, ...]:
        syms = self.merge(text)
        plain = tuple(map(self.ids.get, syms))
        if None not in plain:
            return plain
        ids: list[int] = []
        for s in syms:
            i = self.ids.get(s)
            ids.extend((i,) if i is not None else (self.bytes[b] for b in s.encode()))
        return tuple(ids)

    def joined(self, ids: list[int]) -> str:
        """Decimal ids joined by one blank."""
        return " ".join(map(self.decimal.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        """Ids with the end id."""
        if not text:
            return [self.end]
        marked = MARK + text.replace(" ", MARK)
        parts = self.pattern.findall(marked) if self.pattern else [marked]
        known = self.known
        if len(known) > CACHE:
            known.clear()
        ids = list(chain.from_iterable(map(known.__getitem__, parts)))
        ids.append(self.end)
        return ids


_CODECS: dict[str, PieceCodec] = {}


def _codec(path: str) -> PieceCodec:
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """``<id_col>, n_tokens, ids_sha256, decoded_sha256, agreed`` per row and, with ``keep``, the ids
    and the decoded text themselves."""
    kind = docs.schema[id_col].dataType.simpleString()
    fields = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "agreed": pa.bool_()} | (
        {"ids": pa.list_(pa.int32()), "decoded": pa.string()} if keep else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for b in batches:
            texts = [t or "" for t in b.column("t").to_pylist()]
            checks = codec.library.encode(texts, num_threads=1, add_eos=True)
            rows = []
            for t, check in zip(texts, checks, strict=True):
                ids = codec.encode(t)
                agreed = ids == check
                if not agreed:
                    ids = check
                decoded = codec.library.decode(ids)
                rows.append((len(ids), hashlib.sha256(codec.joined(ids).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(),
                             agreed, *((ids, decoded) if keep else ())))
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), fields.values(), strict=True)] if rows else [
                pa.array([], k) for k in fields.values()]
            yield pa.RecordBatch.from_arrays([b.column("id"), *cols], names=["id", *fields])

    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, agreed boolean" + (
        ", ids array<int>, decoded string" if keep else "")
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
