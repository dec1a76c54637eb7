"""Ranked search, order fingerprints and the conversation trie against plain versions."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from hydroflow.llm import order_minhash, prefix_trie, ranked_search
from hydroflow.llm.ordering import written_in_order

DOCS = "doc_id long, text string, lang string, score long, rank int, item string, signs string, _file string"
ITEMS = "item_id long, text string, doc_id long, rank string, score string"
TURNS = "conv_id long, turn long, role string, text string, ids string, key string, path string, level int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", 1, 2, "x", "y", "z") for d, t in rows], DOCS)


def item_frame(spark, rows):
    return spark.createDataFrame([(i, t, 5, "r", "s") for i, t in rows], ITEMS)


# ranked search ---------------------------------------------------------------------------------

def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k=10):
    bags = [(d, collections.Counter(plain_terms(t))) for d, t in docs]
    big_n, big_l = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item_id, text in dict.fromkeys(items):
        scores = []
        for d, b in bags:
            n, score = sum(b.values()), 0
            m = 25 + 75 * n * big_n // big_l
            for t, times in collections.Counter(plain_terms(text)).items():
                if b[t]:
                    w = math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1)))
                    score += times * w * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item_id, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return sorted(out, key=str)


def some_docs(seed, n, words=60):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    out = [(i, " ".join(rng.choices(names, weights, k=rng.randint(1, 60)))) for i in range(n)]
    return [(d, rng.choice(out)[1] if rng.random() < 0.3 else t) for d, t in out]


@pytest.mark.parametrize("k, block", [(10, 16_384), (3, 17), (1, 5)])
def test_search_is_the_plain_ranking(spark, monkeypatch, k, block):
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", block)
    docs = some_docs(k, 300) + [(900, None), (901, ""), (902, "W1, w2-w3;É é ßx Ａ"), (None, "w1 w50"), (7, "w7 w7 w7"), (7, "w7 w7 w7"),
                                (903, "w3 w59 " * 9000)]
    items = [(i, " ".join(random.Random(i).choices([f"w{j}" for j in range(60)], k=12))) for i in range(20)]
    items += [(100, None), (101, "  "), (102, "É é ＡW2 nothing"), (103, "unknown words"), (None, "w1 w1 w50"), (3, "w7"), (3, "w7"), (4, "w7 w59")]
    found = ranked_search.search(frame(spark, docs).repartition(5), item_frame(spark, items), k).collect()
    assert sorted(map(tuple, found), key=str) == plain_search(docs, items, k)


def test_search_in_several_passes_is_the_same(spark):
    docs, items = some_docs(1, 120), [(i, f"w{i} w{i + 1} w{2 * i}") for i in range(25)]
    a = ranked_search.search(frame(spark, docs), item_frame(spark, items), 4)
    b = ranked_search.search(frame(spark, docs), item_frame(spark, items), 4, item_bytes=60)
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str) == plain_search(docs, items, 4)


def test_search_stops_creating_accumulators_and_loses_nothing():
    rng = random.Random(5)
    docs = [(i, " ".join(["common"] * rng.randint(1, 4) + (["rare"] * 2 if i in (3, 50, 90) else []))) for i in range(400)]
    rows = [(d, t) for d, t in docs]
    vocabulary = {b"common": 0, b"rare": 1}
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows]), pa.array([t for _, t in rows])], ["doc_id", "text"])
    block_row = next(ranked_search._indexer(type("B", (), {"value": vocabulary})())(iter([batch]))).to_pylist()[0]
    block = ranked_search.Block(block_row, 400, sum(len(t.split()) for _, t in rows))
    weights = {0: 1, 1: 5000}
    best = block.best([(1, 5000), (0, 1)], 3)
    assert {docs[i][0] for i, _ in best} == {3, 50, 90}
    full = {i: sum(w * int(block.impact[s + list(block.docs[s:e]).index(i)]) for t, w in weights.items() for s, e, _ in [block.spans[t]]
                   if i in block.docs[s:e]) for i in (3, 50, 90)}
    assert dict(best) == full  # survivors were updated by the common term


def test_search_of_empty_tables(spark):
    none, one = frame(spark, []), frame(spark, [(1, "w1")])
    assert ranked_search.search(none, item_frame(spark, [(1, "w1")])).count() == 0
    assert ranked_search.search(one, item_frame(spark, [])).count() == 0
    assert ranked_search.search(frame(spark, [(1, None), (2, "...")]), item_frame(spark, [(1, "w1")])).count() == 0
    assert ranked_search.search(one, item_frame(spark, [(1, "w1")])).columns == ["item_id", "rank", "doc_id", "score"]


# order fingerprints ----------------------------------------------------------------------------

def spark_hash(*values):
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<i" if isinstance(v, Small) else "<q", v)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


class Small(int):
    """A 32-bit number."""


def plain_signs(text):
    words = [" ", *[w for w in re.split(r"[\x20\x09-\x0D]+", text) if w], " "]
    top = (1 << order_minhash.HASH_BITS) - 1
    pairs = [spark_hash(a, b) & top for a, b in zip(words, words[1:])]
    seen, chosen = collections.Counter(), []
    for place, x in enumerate(pairs):
        chosen.append((spark_hash(x, Small(seen[x])) & top, place))
        seen[x] += 1
    sketches = collections.defaultdict(list)
    for value, place in sorted(chosen):
        sketches[value >> (order_minhash.HASH_BITS - order_minhash.BIN_BITS)].append((place, value))
    return {b: spark_hash(*[v for _, v in sorted(s[:order_minhash.TUPLE])]) & 0xFFFF for b, s in sketches.items()}


def plain_likeness(a, b):
    return sum(b.get(k) == v for k, v in a.items()) / len(a.keys() | b.keys())


def plain_prints(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for i, (d, t) in enumerate(order):
        text, after = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        own, changed, other = plain_signs(text), plain_signs(edited), plain_signs(after)
        line = "".join(f"{b << 16 | own[b]:06x}" for b in sorted(own))
        out.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest(), line, "".join(f"{b << 16 | changed[b]:06x}" for b in sorted(changed)),
                    round(plain_likeness(own, changed), 9), round(plain_likeness(own, other), 9)))
    return sorted(out, key=str)


def test_fingerprints_are_the_plain_ones(spark):
    rng = random.Random(2)
    docs = [(i * 3, " ".join(rng.choices([f"w{j}" for j in range(40)], k=rng.randint(1, 150)))) for i in range(60)]
    docs += [(1, None), (2, ""), (4, " \t\n"), (5, "one"), (7, "\U0001f600 ß é two words"), (8, "again again " * 4000), (10, docs[3][1]), (11, docs[3][1])]
    docs += [(None, "no id here"), (13, "x" * 50_000)]
    found = order_minhash.edited_fingerprints(frame(spark, docs).repartition(4)).drop("next_doc_id").collect()
    assert sorted([(*r[:5], round(r[5], 9), round(r[6], 9)) for r in found], key=str) == plain_prints(docs)


def test_fingerprints_see_the_order_of_text(spark):
    rng = random.Random(4)
    words = [f"w{j}" for j in range(400)]
    moved = words[200:] + words[:200]
    mixed = words[:]
    rng.shuffle(mixed)
    rows = [(1, " ".join(words)), (2, " ".join(words[:390])), (3, " ".join(moved)), (4, " ".join(mixed))]
    signs = {r.doc_id: r.signs for r in order_minhash.with_fingerprint(frame(spark, rows).select("doc_id", "text"), "text", "signs").collect()}
    share = lambda d: len(set(signs[1]) & set(signs[d])) / 64
    assert share(2) > 0.8 > share(3) > 0.2 and share(4) < 0.1


def test_fingerprints_of_repeated_ids_one_row_and_none(spark):
    rows = [(5, f"text {i % 3} of many") for i in range(40)] + [(6, "end")]
    found = order_minhash.edited_fingerprints(frame(spark, rows).repartition(7)).collect()
    assert len(found) == 41 and len({r.fingerprint for r in found}) == 4
    one = order_minhash.edited_fingerprints(frame(spark, [(1, "abcd")])).collect()
    assert [(r.doc_id, r.n_chars, r.near_next, r.next_doc_id, r.edited_sha256) for r in one] == [(1, 4, 1.0, 1, hashlib.sha256(b"abab").hexdigest())]
    assert order_minhash.edited_fingerprints(frame(spark, [])).count() == 0


def test_fingerprints_read_files_in_place(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows = [(i, f"some words {i} and {i * i}") for i in range(30)]
    frame(spark, rows).repartition(3).write.parquet(path)
    a = order_minhash.edited_fingerprints(spark.read.parquet(path), from_files=True)
    b = order_minhash.edited_fingerprints(frame(spark, rows))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_rows_are_numbered_in_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.col("id"))
    ranked, n = written_in_order(rows.repartition(9), [F.col("x")], "numbers")
    assert n == 1000 and all(r["x"] == r["rank"] for r in ranked.collect())


# conversation trie -----------------------------------------------------------------------------

def plain_trie(rows):
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            by[c].append(((t is not None, t or 0), r, hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()[:32], x))
    turns = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in by.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        built[c] = turns.get(base, [])[:h] + own[h:]
    members = collections.defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        own = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += children[p] == 0
    return sorted([(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)).encode()).hexdigest())
                   for p, m in members.items()], key=str)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "i", "k", "p", 3) for r in rows], TURNS)


def trie(spark, rows, most):
    found = prefix_trie.prefix_trie(prefix_trie.rebuilt(conversations(spark, rows).repartition(3)), most)
    return sorted(map(tuple, found.collect()), key=str)


@pytest.mark.parametrize("most", [1, 3, 512])
def test_trie_is_the_plain_one(spark, most):
    rng = random.Random(3)
    rows = []
    for c in range(60):
        n = rng.choice([1, 2, 3, 6, 12])
        rows += [(c, t if t else None, rng.choice(["user", "assistant", None]), rng.choice(["hi", "yes é", "no", None, ""])) for t in range(n)]
    rows += [(c, t, "user", "same") for c in range(100, 130) for t in range(11)]  # one way that many share to its end
    rows += [(c, t, "user", f"t{t}") for c in (200, 205) for t in range(40)] + [(200, 50, "user", "x" * 100_000)]
    rows += [(300, 1, "user", "a"), (300, 1, "user", "a"), (300, 1, "bot", "b"), (None, 1, "user", "nobody"), (-3, 1, "user", "below"), (-10, 2, None, None)]
    rng.shuffle(rows)
    assert trie(spark, rows, most) == plain_trie(rows)


def test_trie_of_turnless_members_and_nothing(spark):
    rows = [(c, t, "user", "x") for c in range(1, 40) for t in range(1)]  # turns that the group lends are absent
    assert trie(spark, rows, 2) == plain_trie(rows)
    assert plain_trie(rows)[0][1] == 0 and trie(spark, [], 2) == []
