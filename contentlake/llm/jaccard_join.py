"""N-gram Jaccard join with set-relation skipping (operator 9).

A document's set holds the 64-bit hashes of its distinct shingles (three words unless told otherwise).
Two documents link when 100 * intersection >= 90 * union (both bounds are parameters). The join has three steps (t is the least similarity):

1. Index lists by position block. Linked sets of at most s elements differ in at most H(s) of them,
   so if the hash order is cut into H(s) + 1 blocks, at least one block is equal in both. An index
   list is keyed by (size class, block, content of the block); the lists of all other positions are
   skipped. A set is listed under its own size class and the next one, which is as far as a linked
   set can be. A few more blocks are made than needed, so that as many of the emptiest may be left
   out. Where H is so large that blocks would hold too few elements to tell sets apart, the lists
   are those of single elements, and a set is listed under its first size - t * size + 12 elements
   in one order of all elements (positions beyond are skipped): linked sets share twelve of these
   lists (three, with small sets and as many fewer elements). Pairs of such lists are counted, and
   so many shared lists make a candidate; a block's list makes a star. Shingles that very many sampled
   documents share are left out of the blocks (whatever is left out of all sets alike, the rest still
   differs in at most H elements) and come last in that order.
   A list of more than ``ALL_PAIRS`` members makes no candidates in this first round: its members go on
   to a second one. A linked pair of which one set has no long list was found in the first round. For
   the sets of the second round, the lists of all their elements are counted over all of these sets;
   they are then listed under single elements anew, in the order: elements of short lists, of long
   ones, common ones. Passages that many documents share thus make few candidates, however many
   passages there are; a long list makes a star only where a document has little else.
   The components of all candidates are the clusters inside which links lie. Lists travel as packed
   arrays, and a list met twice in one task is merged there first.
2. Sets of a cluster meet in groups of two parts (``PART_SETS`` sets, ``PART_TOKENS`` elements each),
   every pair of parts once. In a group, an inverted index keeps its lists in blocks of sets ordered
   by size; blocks whose sizes are out of reach are skipped. The overlaps of a set are derived
   from the computed overlaps of the most similar earlier set: the lists of the elements that one
   has and the other lacks are added or taken away. Only a set that resembles none is counted anew.
3. A group returns for each linked set its root in the group and its number of links; components
   of these give the result.

Exact copies (equal sets) are one set throughout. The lists, not the sets, are shuffled for all
documents; sets are made again for candidates only, found by a bitmap of fixed size (``FILTER_BITS``:
false hits of the bitmap cost time, never a result). Such bitmaps also keep the sets without long lists
out of the second round's shuffle, and ``keep_one`` shuffles only the documents whose key may go or come
twice; the others stay where they are read.

Defined results: null and empty texts, and texts without words, have an empty set and are linked with
nothing (their component is their own id). A text with fewer words than a shingle has is one shingle. A null
id never becomes a component id unless the component has no other. Rows repeat as given.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir, materialize
from .common import free_name, n_tasks
from .components import components

PART_SETS, PART_TOKENS = 1000, 1_000_000
FILTER_BITS = 1 << 25
#: Sets per block of an index list.
BLOCK = 32
#: A set at least this similar to a computed one derives its overlaps from it.
DERIVE = 0.6
WORDS = 250_000
#: Shingles count as common if they are in this many of at most about so many sampled documents; at
#: most so many are kept (1.6 MB). This only shapes the lists: every choice gives the same links.
COMMON_IN, COMMON_SAMPLE, COMMON_MOST = 2, 16_384, 200_000
#: Lists of single elements: large sets that share ``SHARED`` lists are candidates, small ones that
#: share a quarter as many. The members of a list with more than ``ALL_PAIRS`` members are listed anew
#: in a second round; a list that is as long there makes one star of its members, whatever else they share.
SHARED, ALL_PAIRS = 12, 64
#: The two lowest bits of a list's key: how many shared lists make a candidate (all, a quarter, one).
KIND, MANY, FEW, ONE = map(np.uint64, (3, 0, 1, 2))
#: What becomes of long lists: their members go to the second round, are told so, or make stars.
FIRST, COUNT, LAST = range(3)
#: Blocks with fewer elements than this on average are replaced by lists of single elements.
LEAST_IN_BLOCK = 7
#: Entries of index lists that a task gathers before it packs them.
PACK = 1_000_000
#: Entries of a bucket of index lists, as long as there are no more than four buckets a task.
BUCKET = 50_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MULT = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63,
                              0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of a text; word hashes are kept in a table of bounded size."""

    def __init__(self, n: int):
        self.n = n
        from xxhash import xxh3_64_intdigest
        self.hash = xxh3_64_intdigest
        self.words: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # of bytes: A-Z only; white space is 9 to 13 and 32
        if not words:
            return np.empty(0, np.uint64)
        known = self.words
        if len(known) > WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.hash(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(h))
        with np.errstate(over="ignore"):
            total = sum(h[i:len(h) - n + 1 + i] * _MULT[i] for i in range(n)) + np.uint64(n)
            return np.unique(_mix(total))


def max_difference(size: int, num: int, den: int) -> int:
    """Largest symmetric difference of two linked sets of which the larger has ``size`` elements."""
    return 2 * size * (den - num) // (den + num)


def size_classes(size: int, num: int, den: int) -> tuple[int, int, int]:
    """(class of ``size``, largest size of that class, largest size of the next class). Classes are such
    that linked sets lie in the same or in adjacent classes."""
    low, i = 1, 0
    while True:
        high = low * den // num
        if size <= high:
            return i, high, (high + 1) * den // num
        low, i = high + 1, i + 1


def block_plan(top: int, num: int, den: int) -> tuple[int, int]:
    """(blocks, how many of the emptiest may be left out) for sets of at most ``top`` elements; no blocks
    if they would hold too few elements each. Two linked sets have at least blocks - H equal blocks,
    and each of the two leaves out at most (blocks - H - 1) / 2."""
    h = max_difference(top, num, den)
    if not h:
        return 1, 0
    if top < LEAST_IN_BLOCK * (h + 1):
        return 0, 0
    spare = min(h, math.ceil(2 * (h + 1) * math.exp(-top / (h + 1))) + 2)
    return h + 1 + 2 * spare, spare


def _element_lists(ordered: np.ndarray, top: int, num: int, den: int) -> np.ndarray:
    """Keys of the lists of a set's first elements: two linked sets of at most ``top`` elements have
    ``hits`` of these in common, whatever the order of all elements is."""
    size, least = len(ordered), top * num * num // (den * den)  # no linked pair of this class has a smaller overlap
    hits, kind = next((h, k) for h, k in ((SHARED, MANY), (SHARED // 4, FEW), (1, ONE)) if least > h or k == ONE)
    first = ordered[:size - -(-size * num // den) + hits]
    return _mix(first + _MULT[3 + int(kind)]) & ~KIND | kind


def _is_in(tokens: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which tokens are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(tokens), bool)
    return known[np.minimum(np.searchsorted(known, tokens), len(known) - 1)] == tokens


def signatures(tokens: np.ndarray, common: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of the index lists of a set."""
    if not len(tokens):
        return np.empty(0, np.uint64)
    size, (i, own, following) = len(tokens), size_classes(len(tokens), num, den)
    often = _is_in(tokens, common)
    rare = tokens[~often]
    out = []
    with np.errstate(over="ignore"):
        for cls, top in ((i, own), (i + 1, following)):
            blocks, spare = block_plan(top, num, den)
            if blocks == 0:
                out.append(_element_lists(np.concatenate([rare, tokens[often]]), top, num, den))
            elif blocks > 1:  # linked sets of a class without differences are equal
                at = (((rare >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)
                total = np.zeros(blocks, np.uint64)
                np.add.at(total, at, rare)
                key = _mix(total * _MULT[1] + np.uint64(cls) * _MULT[0] + np.arange(blocks, dtype=np.uint64) * _MULT[2])
                out.append(key[np.argsort(np.bincount(at, minlength=blocks), kind="stable")[spare:]] & ~KIND | ONE)
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def ranked_signatures(tokens: np.ndarray, long: np.ndarray, common: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of the index lists of a set in the second round; ``long``: elements whose lists are long."""
    with np.errstate(over="ignore"):
        rank = _is_in(tokens, np.unique(long)).astype(np.int8)
        rank[_is_in(tokens, common) & (rank > 0)] = 2
        ordered = tokens[np.argsort(rank, kind="stable")]
        out = [_element_lists(ordered, top, num, den) for top in size_classes(len(tokens), num, den)[1:] if max_difference(top, num, den)]
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit keys of a set."""
    with np.errstate(over="ignore"):
        a, b = _mix(tokens + np.uint64(7)).sum(dtype=np.uint64), _mix(tokens * _MULT[2] + np.uint64(len(tokens))).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


_SHINGLERS: dict[int, Shingler] = {}


def _shingler(n: int) -> Shingler:
    if n not in _SHINGLERS:
        _SHINGLERS[n] = Shingler(n)
    return _SHINGLERS[n]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _index(common: np.ndarray, num: int, den: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = _shingler(shingle)
        for b in batches:
            sets = [make(t.as_py()) for t in b.column("t")]
            keys = [set_key(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                 pa.array([len(s) for s in sets], pa.int64()), _lists([signatures(s, common, num, den) for s in sets])],
                names=["id", "h1", "h2", "size", "sigs"])
    return run


def _common(texts: DataFrame, shingle: int) -> np.ndarray:
    """Shingles of many documents, from a sample taken by a hash of the text (copies once per task)."""
    rate = min(1.0, COMMON_SAMPLE / max(texts.count(), 1))
    some = texts.where(F.col("t").isNotNull() & (F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < int(rate * 1_000_000))).select("t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen = _shingler(shingle), set()
        for b in batches:
            sets = {set_key(x): x for x in (make(t.as_py()) for t in b.column("t"))}
            new = [x for k, x in sets.items() if k not in seen]
            seen.update(sets)
            yield pa.RecordBatch.from_arrays([_lists(new)], names=["tokens"])

    found = some.mapInArrow(run, "tokens array<long>").select(F.explode("tokens").alias("token")).groupBy("token").count()
    rows = found.where(F.col("count") >= COMMON_IN).orderBy(F.desc("count"), "token").limit(COMMON_MOST).collect()
    return np.sort(np.array([r["token"] for r in rows], np.int64).view(np.uint64))


def _lists_of(sig: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(list, member) pairs sorted, each once; where each list starts, and how many members it has."""
    order = np.lexsort((key, sig))
    sig, key = sig[order], key[order]
    if len(sig):
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])])
        sig, key = sig[new], key[new]
    starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.empty(0, np.int64)
    return sig, key, starts, np.diff(np.concatenate([starts, [len(sig)]]))


def _stars(sig: np.ndarray, key: np.ndarray, starts: np.ndarray, n: np.ndarray, mode: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (least member, other member) of the lists that make stars."""
    star = np.repeat((n > ALL_PAIRS) | (sig[starts] & KIND == ONE) if mode == LAST else (n <= ALL_PAIRS) & (sig[starts] & KIND == ONE), n)
    least = np.repeat(key[starts], n)
    other = star & (least != key)
    return least[other], key[other]


def _long(sig: np.ndarray, key: np.ndarray, starts: np.ndarray, n: np.ndarray, mode: int) -> tuple[np.ndarray, np.ndarray]:
    """What is told of the long lists: their (list, member) pairs, or their members alone."""
    long = np.repeat(n > ALL_PAIRS, n)
    if mode == COUNT:
        return sig[long].view(np.int64), key[long]
    members = np.unique(key[long])
    return members, members


def _pairs(kind: np.uint64, sig: np.ndarray, key: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of the members of the short lists of one kind."""
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for size in range(2, ALL_PAIRS + 1):
        at = starts[(n == size) & (sig[starts] & KIND == kind)]
        i, j = np.triu_indices(size, 1)
        a.append(key[(at[:, None] + i).ravel()])
        b.append(key[(at[:, None] + j).ravel()])
    return np.concatenate(a), np.concatenate(b)


PACKED = "bucket int, edges boolean, a binary, b binary"


def _pack(buckets: int, mode: int):
    """Rows (key, lists) -> packed lists by bucket, and edges. What becomes of a list that is long in this
    task alone is told here; its first members travel on, enough for the next step to see that it is long."""
    def flush(sig: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        sig, key, starts, n = _lists_of(sig, key)
        first, other = (_stars if mode == LAST else _long)(sig, key, starts, n, mode)
        place = np.arange(len(sig)) - np.repeat(starts, n)
        kept = place < np.repeat(np.where((sig[starts] & KIND == ONE) & (mode == LAST), 1, ALL_PAIRS + 1), n)
        sig, key = sig[kept], key[kept]
        bucket = ((sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))  # lists are sorted, and so are their buckets
        rows = [(b, False, sig[i:j].tobytes(), key[i:j].tobytes()) for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if i < j]
        if len(first):
            rows.append((int(first[0] % buckets), True, first.tobytes(), other.tobytes()))
        kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                             names=["bucket", "edges", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, keys, n = [], [], 0
        for b in batches:
            lists = b.column("sigs")
            sigs.append(lists.flatten().to_numpy().view(np.uint64))
            keys.append(np.repeat(b.column("h1").to_numpy(), lists.value_lengths().to_numpy()))
            n += len(sigs[-1])
            if n > PACK:
                yield from flush(np.concatenate(sigs), np.concatenate(keys))
                sigs, keys, n = [], [], 0
        if n:
            yield from flush(np.concatenate(sigs), np.concatenate(keys))
    return run


def _unpack(mode: int):
    """Packed rows sorted by bucket -> ``first, h1, hits``: stars' edges count as enough hits, pairs as their
    share. Of long lists, FIRST gives (member, member, -1), COUNT (list, member, 0) and nothing else."""
    told = {FIRST: -1, COUNT: 0, LAST: SHARED}[mode]

    def rows(edges: tuple[np.ndarray, np.ndarray], hits: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(edges[0], pa.int64()), pa.array(edges[1], pa.int64()),
                                           pa.array(np.full(len(edges[0]), hits), pa.int64())], names=["first", "h1", "hits"])

    def bucket(parts: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        found = _lists_of(*(np.frombuffer(b"".join(p), kind) for p, kind in zip(zip(*parts, strict=True), (np.uint64, np.int64), strict=True)))
        if mode != LAST:
            yield rows(_long(*found, mode), told)
        if mode != COUNT:
            yield rows(_stars(*found, mode), SHARED)
            yield rows(_pairs(MANY, *found), 1)
            yield rows(_pairs(FEW, *found), 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["edges"]:
                    yield rows((np.frombuffer(r["a"], np.int64), np.frombuffer(r["b"], np.int64)), told)
                    continue
                if r["bucket"] != at and parts:
                    yield from bucket(parts)
                    parts = []
                at = r["bucket"]
                parts.append((r["a"], r["b"]))
        if parts:
            yield from bucket(parts)
    return run


def _met(members: DataFrame, mode: int, entries: int) -> DataFrame:
    """``first, h1, hits`` of the lists of ``members`` (``h1, sigs``), which have about so many entries."""
    tasks = n_tasks(members.sparkSession)
    packed = members.mapInArrow(_pack(max(1, min(4 * tasks, entries // BUCKET)), mode), PACKED)
    return packed.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_unpack(mode), "first long, h1 long, hits long")


def _rank(common: np.ndarray, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs = [ranked_signatures(np.array(t, np.int64).view(np.uint64), np.array(n, np.int64).view(np.uint64), common, num, den)
                    for t, n in ((t.values.to_numpy(), n.values.to_numpy() if n.is_valid else [])
                                 for t, n in zip(b.column("tokens"), b.column("long"), strict=True))]
            yield pa.RecordBatch.from_arrays([b.column("h1"), _lists(sigs)], names=["h1", "sigs"])
    return run


def _bitmap(keys: DataFrame) -> dict[int, bytes]:
    """The bits of the 64-bit ``key`` of all rows, by bucket of 2^15 bits; ``FILTER_BITS`` at most."""
    bit = F.pmod("key", F.lit(FILTER_BITS))
    bits = keys.select((F.shiftright(bit, 15)).alias("bucket"), bit.bitwiseAND(F.lit(32767)).alias("bit"))
    return {r[0]: bytes(r[1]) for r in bits.groupBy("bucket").agg(F.bitmap_construct_agg("bit")).collect()}


def _hit(bitmap: dict[int, bytes]):
    """Column function: whether the bit of a 64-bit key is in the bitmap."""
    @F.arrow_udf("boolean")
    def hit(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        buckets = np.zeros((FILTER_BITS >> 15, 1 << 12), np.uint8)
        for k, v in bitmap.items():
            buckets[k] = np.frombuffer(v, np.uint8)
        flat = buckets.ravel()
        for keys in batches:
            bit = keys.to_numpy(zero_copy_only=False) % FILTER_BITS
            yield pa.array((flat[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool))
    return hit


def _candidate_sets(bitmap: dict[int, bytes], shingle: int):
    """Sets of the texts whose key is in the bitmap, each set once per task."""
    buckets = {k: np.frombuffer(v, np.uint8) for k, v in bitmap.items()}

    def wanted(h: int) -> bool:
        bit = h % FILTER_BITS
        part = buckets.get(bit >> 15)
        return part is not None and bool(part[(bit & 32767) >> 3] >> (bit & 7) & 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen = _shingler(shingle), set()
        for b in batches:
            keys, sets = [], []
            for t in b.column("t"):
                s = make(t.as_py())
                k = set_key(s)
                if len(s) and wanted(k[0]) and k not in seen:
                    seen.add(k)
                    keys.append(k)
                    sets.append(s)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                                              _lists(sets)], names=["h1", "h2", "tokens"])
    return run


class BlockedIndex:
    """Inverted lists over sets ordered by size, in blocks of ``BLOCK`` sets: the part of a list that
    lies in a range of blocks is one slice."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets])
        vocabulary, tokens = np.unique(np.concatenate(sets), return_inverse=True)
        self.blocks = -(-len(sets) // BLOCK)
        where = np.repeat(np.arange(len(sets)), sizes)
        self.sets = np.split(tokens, np.cumsum(sizes)[:-1])
        key = tokens * self.blocks + where // BLOCK
        order = np.argsort(key, kind="stable")
        self.postings = where[order]
        filled, n = np.unique(key, return_counts=True)
        self.starts = np.zeros(len(vocabulary) * self.blocks + 1, np.int32)  # most lists are empty in most blocks
        self.starts[filled + 1] = n
        np.cumsum(self.starts, out=self.starts)
        self.n = len(sets)

    def count(self, tokens: np.ndarray, first: int, last: int) -> np.ndarray:
        """How many of ``tokens`` each set of the blocks ``first`` to ``last`` has (0 for the others)."""
        a, b = self.starts[tokens * self.blocks + first], self.starts[tokens * self.blocks + last + 1]
        n = b - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(self.postings[at], minlength=self.n)


def linked(sets: list[np.ndarray], parts: np.ndarray, one_part: bool, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """(set, sets it links with) for sets in order of size; sets of one part are compared only in
    that part's own group (``one_part``)."""
    index, sizes = BlockedIndex(sets), np.array([len(s) for s in sets])
    todo = np.ones(len(sets), bool)
    done: dict[int, tuple[np.ndarray, int, int]] = {}
    at, overlap = 0, None
    for _ in range(len(sets)):
        base = None
        if overlap is not None:
            near = np.where(todo, overlap / np.maximum(sizes + sizes[at] - overlap, 1), -1.0)
            nxt = int(near.argmax())
            if near[nxt] >= DERIVE:
                base, (known, lo, hi) = at, done[at]
            else:
                nxt = int(todo.argmax())
        else:
            nxt = 0
        x, s = index.sets[nxt], sizes[nxt]
        # Blocks that hold sets within reach of s; a range a little wider serves sets derived from this one.
        need = np.searchsorted(sizes, -(-s * num // den)) // BLOCK, (np.searchsorted(sizes, s * den // num, "right") - 1) // BLOCK
        if base is not None and lo <= need[0] and need[1] <= hi:
            y = index.sets[base]
            overlap = known + index.count(np.setdiff1d(x, y, True), lo, hi) - index.count(np.setdiff1d(y, x, True), lo, hi)
        else:
            lo = int(np.searchsorted(sizes, s * num * num // (den * den)) // BLOCK)
            hi = int((np.searchsorted(sizes, s * den * den // (num * num), "right") - 1) // BLOCK)
            overlap = index.count(x, lo, hi)
        at, todo[nxt] = nxt, False
        done = {nxt: (overlap, lo, hi)}
        ok = den * overlap >= num * (sizes + s - overlap)
        ok[nxt] = False
        if not one_part:
            ok &= parts != parts[nxt]
        yield nxt, np.flatnonzero(ok)


GROUP = "set string, root string, links long"


def _join_group(num: int, den: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        h1, h2, part = (t.column(c).to_numpy() for c in ("h1", "h2", "part"))
        tokens = t.column("tokens").combine_chunks()
        flat, offsets = tokens.flatten().to_numpy().view(np.uint64), np.asarray(tokens.offsets) - tokens.offsets[0].as_py()
        rows = {(a, b): n for n, (a, b) in enumerate(zip(h1.tolist(), h2.tolist(), strict=True))}  # copies from several tasks
        keep = sorted(rows.values(), key=lambda n: (offsets[n + 1] - offsets[n], h1[n], h2[n]))
        sets = [flat[offsets[n]:offsets[n + 1]] for n in keep]
        names = [f"{int(h1[n]) & (1 << 64) - 1:016x}{int(h2[n]) & (1 << 64) - 1:016x}" for n in keep]
        root = list(range(len(keep)))
        one_part = t.column("p")[0] == t.column("q")[0]

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        links = np.zeros(len(keep), np.int64)
        # In a group of two parts one may have no sets: the pairs of the other belong to its own group.
        if len(keep) > 1 and (one_part or len(np.unique(part[keep])) > 1):
            for i, others in linked(sets, part[keep], one_part, num, den):
                links[i] = len(others)
                for j in others.tolist():
                    root[find(j)] = find(i)
        some = np.flatnonzero(links).tolist()
        return pa.table({"set": [names[i] for i in some], "root": [names[find(i)] for i in some], "links": links[some]},
                        schema=pa.schema([("set", pa.string()), ("root", pa.string()), ("links", pa.int64())]))

    run.__annotations__ = {"t": pa.Table, "return": pa.Table}
    return run


def join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", num: int = 90, den: int = 100,
         shingle: int = 3) -> DataFrame:
    """``<id_col>, n_shingles, component_id, n_links`` for every row; ``n_links`` counts the different
    sets it links with (copies of its own set are not counted)."""
    rows = _components(docs, F.col(id_col), docs.schema[id_col].dataType.simpleString(), text, num, den, shingle)
    least = rows.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("id").alias("component_id"))
    rows = rows.join(least, "component", "left")
    return rows.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"),
                       F.coalesce("component_id", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _candidates(texts: DataFrame, base: DataFrame, common: np.ndarray, num: int, den: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(``h1, h2, tokens`` of the sets that may have links, each once a task; candidate pairs ``first, h1``)."""
    def entries(of: DataFrame, lists: str) -> int:
        return of.agg(F.coalesce(F.sum(F.size(lists).cast("long")), F.lit(0))).first()[0]

    n = entries(base, "sigs")
    met = _met(base.select("h1", "sigs"), FIRST, n).groupBy("first", "h1").agg(F.sum("hits").alias("hits"))
    met = materialize(met.where((F.col("hits") >= SHARED) | (F.col("hits") < 0)))
    edges, again = met.where("hits > 0").select("first", "h1"), met.where("hits < 0").select("h1")

    bitmap = _bitmap(met.select(F.explode(F.array("first", "h1")).alias("key")))
    sets = materialize(texts.select("t").mapInArrow(_candidate_sets(bitmap, shingle), "h1 long, h2 long, tokens array<long>"))

    if not again.isEmpty():
        # The bitmap leaves most other sets where they are, the join the rest of them.
        some = sets.where(_hit(_bitmap(again.withColumnRenamed("h1", "key")))(F.col("h1"))).select("h1", "tokens").join(again, "h1")
        long = _met(some.select("h1", F.col("tokens").alias("sigs")), COUNT, entries(sets, "tokens")).groupBy("h1").agg(F.collect_list("first").alias("long"))
        ranked = some.join(long, "h1", "left").mapInArrow(_rank(common, num, den), "h1 long, sigs array<long>")
        more = _met(ranked, LAST, n).groupBy("first", "h1").agg(F.sum("hits").alias("hits")).where(F.col("hits") >= SHARED)
        edges = edges.unionByName(more.select("first", "h1"))
    return sets, edges


def _components(docs: DataFrame, key: Column, kind: str, text: str, num: int, den: int, shingle: int) -> DataFrame:
    """``id`` (the key, of type ``kind``), ``size``, ``set``, ``component`` and ``n_links`` of every row; the component
    of an empty set is null."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    texts = docs.select(key.alias("id"), F.col(text).alias("t"))
    common = _common(texts, shingle)
    base = materialize(texts.mapInArrow(_index(common, num, den, shingle), f"id {kind}, h1 long, h2 long, size long, sigs array<long>"))
    sets, edges = _candidates(texts, base, common, num, den, shingle)
    clusters = components(edges, "first", "h1")  # of first keys: two sets that share one only share a cluster

    sized = base.select("h1", "h2", "size").distinct().join(clusters.withColumnRenamed("node", "h1"), "h1")
    parts = sized.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / PART_SETS), F.ceil(F.sum("size") / PART_TOKENS))
                                      .cast("int").alias("parts"))
    members = materialize(clusters.join(parts, "root").select(F.col("node").alias("h1"), "root", "parts"))

    sets = sets.join(members, "h1")
    part = F.pmod(F.xxhash64("h1", "h2"), F.col("parts")).cast("int")
    # A part meets itself and every other part: the group of parts p <= q.
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    sets = sets.select("h1", "h2", "tokens", "root", part.alias("part"), other.alias("other"))
    sets = sets.select("h1", "h2", "tokens", "part", "root", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    found = materialize(sets.groupBy("root", "p", "q").applyInArrow(_join_group(num, den), GROUP))

    label = components(found.select("set", "root"), "set", "root").select(F.col("node").alias("set"), F.col("root").alias("component"))
    degree = found.groupBy("set").agg(F.sum("links").alias("n_links"))
    name = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    rows = base.select("id", "size", F.when(F.col("size") > 0, F.concat(name("h1"), name("h2"))).alias("set"))
    rows = rows.join(label.join(degree, "set", "left"), "set", "left")
    return rows.withColumn("component", F.coalesce("component", "set"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", num: int = 90, den: int = 100, shingle: int = 3) -> DataFrame:
    """One document of each component, the one with the smallest id, with its own columns. Rows with a
    null id all stay; of a component's rows that share the smallest id the text with the smallest hash
    stays. Rows that share an id and are in different components are treated apart, and so are
    different texts without words, which are linked with nothing."""
    row, kind = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h")), docs.schema[id_col].dataType.simpleString()
    rows = _components(docs, row, f"struct<id: {kind}, h: bigint>", text, num, den, shingle).where(F.col("id.id").isNotNull())
    keys = materialize(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("component")))
    first = keys.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("first"))
    goes = F.col("component").isNotNull() & F.col("first").isNull()
    odd = keys.join(first, "id", "left").where(goes | (F.col("n") > 1)).select(F.col("id.id").alias("odd_id"), F.col("id.h").alias("odd_hash"), goes.alias("goes"))
    odd = materialize(odd)
    # Only rows whose key goes or comes twice need their likes; the bitmap finds them, and a few others.
    hit = _hit(_bitmap(odd.select(F.xxhash64("odd_id", "odd_hash").alias("key"))))(F.xxhash64(id_col, F.xxhash64(text)))
    h = free_name(docs, "text_hash")
    some = docs.where(F.col(id_col).isNotNull() & hit).withColumn(h, F.xxhash64(text))
    kept = some.join(odd.where("goes"), (F.col(id_col) == F.col("odd_id")) & (F.col(h) == F.col("odd_hash")), "left_anti")
    return kept.dropDuplicates([id_col, h]).select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull() | ~hit))
