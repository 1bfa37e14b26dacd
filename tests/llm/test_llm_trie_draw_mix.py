"""Prefix trie, importance resampling and curriculum against brute force; edge cases of each."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from contentlake.llm import curriculum, importance_resampling, prefix_trie, queries
from contentlake.llm.common import begin

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TURNS = "conv_id long, turn long, role string, text string, depth string, words long"
DOCS = "doc_id long, text string, source string, lang string, rank long, mix string, draw string"


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    begin(spark)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# 11 ------------------------------------------------------------------------------------------------

def plain_trie(turns):
    """Nodes of the trie, from whole sequences held in dictionaries."""
    own = defaultdict(list)
    for c, t, role, text, *_ in turns:
        if c is not None:
            role, text = role or "", text or ""
            g = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((t is not None, t or 0, g, role, text))
    own = {c: [x[3:] for x in sorted(xs)] for c, xs in own.items()}
    whole = {}
    for c, xs in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        whole[c] = tuple(own.get(base, [])[:h] + xs[h:])
    members = defaultdict(list)
    for c, xs in whole.items():
        for d in range(len(xs) + 1):
            members[xs[:d]].append(c)
    children = Counter(k[:-1] for k in members if k)
    out = []
    for k, cs in members.items():
        below = [j for j in members if j[:len(k)] == k]
        ends = sorted(c for c in cs if len(whole[c]) == len(k))
        out.append({"conv_id": min(cs), "depth": len(k), "parent_conv_id": min(members[k[:-1]]) if k else None, "n_convs": len(cs),
                    "n_children": children[k], "n_leaves": sum(1 for j in below if not children[j]),
                    "saved_tokens": sum((len(members[j]) - 1) * len(words_of(j[-1][1])) for j in below if j),
                    "ends_sha256": hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()})
    return out


def order(xs):
    return sorted(xs, key=lambda x: (x["conv_id"], x["depth"]))


def some_turns(n, seed, vocabulary):
    r = random.Random(seed)
    out = []
    for c in r.sample(range(-25, 6 * n), n):
        for t in range(r.randrange(1, 7)):
            out.append((c, r.choice([t, t, None]), r.choice(["user", "bot", None]) if seed % 2 else "user",
                        r.choice([*vocabulary, None, ""]), "own", 1))
    return out


@pytest.mark.parametrize("seed, shard, limit, band", [(1, 4096, 100, 1024), (2, 2, 3, 2), (4, 5, 100, 3), (6, 16, 2, 1)])
def test_trie_equals_brute_force(spark, monkeypatch, seed, shard, limit, band):
    monkeypatch.setattr(prefix_trie, "BAND", band)
    turns = some_turns(70, seed, ["a", "b c"] if seed % 2 == 0 else ["a", "two words", "und so weiter", "x"])
    turns += [(500, t, "user", "a", "own", 1) for t in range(40)] + [(501, t, "user", "a", "own", 1) for t in range(40)]
    turns += [(None, 1, "user", "lost", "own", 1), turns[0], turns[0]]
    df = spark.createDataFrame(turns, TURNS).repartition(5)
    got = rows(prefix_trie.build(df, shard, limit))
    assert order(got) == order(plain_trie(turns))


def test_trie_of_common_conversations(spark):
    """Hundreds of equal conversations and of ones that share a first turn, over shards of four members."""
    turns = [(c, t, "user", f"t{t}" if t < 2 + (c % 3 == 0) * 3 else f"{c} {t}", "own", 1) for c in range(0, 400) for t in range(5)]
    df = spark.createDataFrame(turns, TURNS).repartition(7)
    assert order(rows(prefix_trie.build(df, 4, 10))) == order(plain_trie(turns))


def test_trie_without_conversations(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.build(none).collect() == []
    only_null = spark.createDataFrame([(None, 1, "user", "x", "own", 1)], TURNS)
    assert prefix_trie.build(only_null).collect() == []


def test_trie_of_a_turnless_conversation(spark):
    c = next(c for c in range(1, 200) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)
    turns = [(c, 0, "user", "gone", "own", 1), (c, 1, "user", "gone", "own", 1)]  # its block's first conversation is absent
    assert rows(prefix_trie.build(spark.createDataFrame(turns, TURNS))) == plain_trie(turns)


def test_members_in_pieces_have_the_digest_of_the_whole(spark):
    ids = [3, 70_000, -5, 2 ** 40, 65_536, 10, 9]
    path = spark.createDataFrame([(c, 1, 1, 11, 22) for c in ids], "conv_id long, i long, len long, k1 long, k2 long")
    convs = spark.createDataFrame([(c, 1) for c in ids], "conv_id long, len long")
    want = hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    for chunk in (1, 4, 16):
        assert rows(prefix_trie.member_digests(path, convs, chunk)) == [{"k1": 11, "k2": 22, "sha": want}]


def test_message_queue_spills_in_order():
    r = random.Random(5)
    q, held, out = prefix_trie.MessageQueue(8), [], []
    for _ in range(2000):
        if held and r.random() < 0.45:
            assert q.least() == min(held)
            x = q.pop()
            assert x == min(held)
            held.remove(x)
            out.append(x)
        else:
            x = (r.randrange(-50, 50), r.randrange(5), r.randrange(3), r.randrange(2 ** 40))
            q.push(x)
            held.append(x)
    assert q.files and len(q.heap) <= 8


# 12 ------------------------------------------------------------------------------------------------

def features(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(ws), [" ".join(ws[i:i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)]


def plain_draw(docs, target, percent, least, seed=42):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([d[1] for d in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    out = []
    for d in docs:
        n, fs = features(d[1])
        h = int(hashlib.sha256(f"{seed}:{'' if d[0] is None else d[0]}".encode()).hexdigest()[:8], 16)
        w = sum(gain[bucket(f)] for f in fs)
        out.append({"doc_id": d[0], "n_words": n, "n_features": len(fs), "weight": w,
                    "score": w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), "rank": None})
    fit = sorted((x for x in out if x["n_words"] >= least), key=lambda x: (-x["score"], x["doc_id"] is not None, x["doc_id"] or 0, x["n_features"]))
    for i, x in enumerate(fit[:len(fit) * percent // 100]):
        x["rank"] = i + 1
    return out


def some_docs(n, seed):
    r = random.Random(seed)
    vocabulary = ["the", "Of", "x1", "é", "日本", "a-b", "ONE", "w\x00z", "İ", " q", "__", "z"]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 60))), f"s{r.randrange(4)}", "en", 1, "own", "own") for i in range(n)]
    return docs + [(n, None, None, None, None, None, None), (n + 1, "", "s0", "en", 1, "own", "own"), (None, "a null id " * 9, "s1", "en", 1, "own", "own"),
                   docs[3], docs[3], (n + 2, "word " * 30_000, "s2", "en", 1, "own", "own"), (n + 3, "x" * 200_000, "s2", "en", 1, "own", "own"),
                   (n + 4, "!?, " * 500, "s3", "en", 1, "own", "own")]


def key(x):
    return [(v is not None, v) for v in x.values()]


def test_draw_equals_brute_force(spark):
    docs, target = some_docs(80, 3), ["the é 日本 the of", None, "x1 x1 x1 one one", ""]
    df = spark.createDataFrame(docs, DOCS).repartition(4)
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got, v = importance_resampling.resample(df, aim, percent=30, least_words=5)
    assert got.columns == [*df.columns, v] and v == "_draw"
    flat = [{"doc_id": x["doc_id"], **x[v]} for x in rows(got)]
    assert sorted(flat, key=key) == sorted(plain_draw(docs, target, 30, 5), key=key)


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 20, 10_000])
def test_runs_reach_across_pieces(piece):
    r = random.Random(piece)
    for n in (0, 1, 2, 3, 4, 50):
        text = r.choice(["", " ", "--"]) + " ".join(r.choice(["a", "Bc", "é", "9", "word", "日本"]) for _ in range(n)) + r.choice(["", "  .  "])
        parts = list(importance_resampling.runs(text.encode(), 10_000, piece))
        got = Counter(np.concatenate([p[1] for p in parts]).tolist()) if parts else Counter()
        assert got == Counter(zlib.crc32(f.encode()) % 10_000 for f in features(text)[1])
        assert sum(p[0] for p in parts) == features(text)[0]


def test_draw_without_documents_or_target(spark):
    none = spark.createDataFrame([], DOCS)
    aim = spark.createDataFrame([], "text string")
    assert importance_resampling.resample(none, aim)[0].collect() == []
    docs = some_docs(30, 9)
    got, v = importance_resampling.resample(spark.createDataFrame(docs, DOCS), aim, percent=50, least_words=10, columns=["doc_id"])
    assert sorted([{"doc_id": x["doc_id"], **x[v]} for x in rows(got)], key=key) == sorted(plain_draw(docs, [], 50, 10), key=key)


def test_draw_prefers_texts_like_the_target(spark, sf_dir):
    out = rows(queries.op12_importance_resampling(spark, sf_dir))
    drawn = [x for x in out if x["rank"] is not None]
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert len(out) == n and sorted(x["rank"] for x in drawn) == list(range(1, len(drawn) + 1)) and 0 < len(drawn) <= 5 * n // 100


# 13 ------------------------------------------------------------------------------------------------

def plain_targets(sizes, weights, most):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        rest, all_w = total - sum(most * sizes[s] for s in full), sum(w[s] for s in open_)
        share = {s: most * sizes[s] if s in full else rest * w[s] / all_w for s in names}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return share
        full |= set(over)


def demand(knots, time, n=4000):
    """Part of a schedule's integral up to a time, by sums of small steps."""
    ts = np.linspace(0, 1, n + 1)
    f = np.interp(ts, *zip(*knots))
    cum = np.concatenate([[0], np.cumsum((f[1:] + f[:-1]) / 2 / n)])
    return float(np.interp(time, ts, cum) / cum[-1])


def test_mix_takes_each_sources_target(spark):
    docs = some_docs(60, 21) + [(1000 + i, "one two three", "rare" if i < 2 else None, "en", 1, "own", "own") for i in range(6)]
    df = spark.createDataFrame(docs, DOCS).repartition(5)
    schedules = [((0, 1), (0.25, 3), (1, 0)), ((0, 0), (0.5, 0), (1, 4)), ((0, 2), (1, 2))]
    got, v = curriculum.mix(df, schedules)
    assert got.columns == [*df.columns, v] and v == "_mix"
    out = rows(got)
    assert len(out) == len(docs)
    sizes = Counter()
    for d in docs:
        sizes[d[2]] += len(words_of(d[1]))
    want = plain_targets(dict(sizes), [curriculum.integral(k) for k in schedules], 3)
    taken = Counter()
    for x in out:
        m = x[v]
        assert m["size"] == len(words_of(x["text"])) and m["source_size"] == sizes[x["source"]]
        assert m["target"] == pytest.approx(want[x["source"]]) and m["target"] <= 3 * m["source_size"]
        assert m["taken"] == sum(c["words"] for c in m["copies"]) <= 3 * m["size"] and len(m["copies"]) <= 3
        assert (m["position"] is None) == (m["taken"] == 0)
        taken[x["source"]] += m["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= 0.5 + 1e-6
    # Training positions: every copy begins when its source's schedule has asked for the words before it.
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    of = {s: schedules[i % 3] for i, s in enumerate(names)}
    seq = rows(curriculum.in_order(got, v))
    assert [x[v]["position"] for x in seq] == sorted(x[v]["position"] for x in seq)
    before = Counter()
    for x in seq:
        s, c = x["source"], x[v]
        assert demand(of[s], c["time"]) * want[s] == pytest.approx(before[s], abs=2 + want[s] / 500)
        assert c["position"] == pytest.approx(sum(demand(of[q], c["time"]) * want[q] for q in names), abs=2 + sum(want.values()) / 500)
        before[s] += c["words"]
    assert [x[v]["position"] for x in out if x[v]["taken"]] == sorted(x[v]["position"] for x in out if x[v]["taken"])


def test_mix_reruns_agree_and_empty_tables(spark):
    docs = some_docs(40, 5)
    a, b = (sorted(map(str, rows(curriculum.mix(spark.createDataFrame(docs, DOCS).repartition(n), queries.SCHEDULES)[0]))) for n in (2, 7))
    assert a == b
    assert curriculum.mix(spark.createDataFrame([], DOCS), queries.SCHEDULES)[0].collect() == []
    blank = spark.createDataFrame([(1, None, "a", "en", 1, "o", "o"), (2, " ", None, "en", 1, "o", "o")], DOCS)
    got, v = curriculum.mix(blank, queries.SCHEDULES)
    assert [(x[v]["size"], x[v]["taken"], x[v]["target"], x[v]["copies"]) for x in rows(got)] == [(0, 0, 0.0, [])] * 2


@pytest.mark.parametrize("knots", [((0, 1),), ((0, 1), (0.9, 1)), ((0, -1), (1, 1)), ((0, 0), (1, 0))])
def test_schedules_that_cannot_be_inverted_are_refused(knots):
    with pytest.raises(ValueError):
        curriculum.segments(knots)
