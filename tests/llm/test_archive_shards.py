"""Archive, shards, token files and packing against plain versions."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hydroflow.llm import kd_sharding, packing, tokens, warc_archive, wavelet
from hydroflow.llm.common import scratch_path
from hydroflow.llm.tokens import WordTable

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, start long"
LONG = " ".join(f"word{i % 977} of, the {i}\nline" for i in range(9000))
ROWS = [(1, "Hello there, world.", "en", "a", 5, 9, 9), (2, None, None, None, None, 9, 9), (3, "", "", "", 0, 9, 9), (4, LONG, "en", "a", 1, 9, 9),
        (5, "Hello there, world.", "en", "a", 5, 9, 9), (5, "Hello there, world.", "en", "a", 5, 9, 9), (7, "a\n\nb  c\td é 🙂", "fr", "b", 9, 9, 9),
        (None, "no id", "en", "a", 5, 9, 9)] + [(100 + i, f"text number {i} " * (1 + i % 7), "de", f"s{i % 3}", 3, 9, 9) for i in range(120)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


def test_archive_round_trip(spark):
    big = "<p>é</p>" * 40
    rows = [(1, "http://a", big, "x"), (2, "http://b", big, "x"), (2, "http://b", big, "x"), (3, None, None, "x"), (4, "http://c", "", None),
            (5, "http://d", "short", "x"), (6, "http://e", "short", "x"), (None, "http://f", big, "x"), (0, "http://g", "other" * 50, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    folder = scratch_path(spark, "test-warc")
    warc_archive.write_archive(pages, folder)
    records = warc_archive.read_records(spark, folder).collect()
    assert len(records) == len(rows)
    for r in records:
        assert hashlib.sha256(bytes(r["payload"])).hexdigest() == r["payload_digest"]
    kinds = sorted((r["page_id"] if r["page_id"] is not None else -1, r["record_type"], r["refers_to"]) for r in records)
    assert kinds == [(-1, "revisit", 1), (0, "response", None), (1, "response", None), (2, "revisit", 1), (2, "revisit", 1),
                     (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None)]
    whole = {r["page_id"]: bytes(r["record"]) for r in warc_archive.record_bytes(warc_archive.read_records(spark, folder)).collect()}
    head, _, body = whole[1].partition(b"\r\n\r\n")
    size = int(head.decode().split("Content-Length: ")[1].split("\r\n")[0])
    assert body[:size].endswith(big.encode()) and body[size:] == b"\r\n\r\n"
    assert spark.read.parquet(folder + "/payloads").count() == 4
    found = {r["page_id"]: r["payload_bytes"] for r in warc_archive.page_digests(spark, folder).collect()}
    assert found[1] == len(big.encode()) and found[3] == 0


def test_empty_archive(spark):
    folder = scratch_path(spark, "test-warc")
    warc_archive.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc_archive.page_digests(spark, folder).count() == 0


def _plain_kd(rows, shards, first=0):
    """The same tree by sorting whole boxes."""
    if shards == 1 or not rows:
        return {id(r): first for r in rows}
    d = max(kd_sharding.DIMENSIONS, key=lambda c: max(r[c] for r in rows) - min(r[c] for r in rows))
    key = lambda r: (r[d], r["tie"])
    left, target, total, before = shards // 2, -(-sum(r["size"] for r in rows) * (shards // 2) // shards), 0, 0
    cut = None
    for k in sorted({key(r) for r in rows}):
        before, total = total, total + sum(r["size"] for r in rows if key(r) == k)
        if total >= target:
            cut, inside = k, target - before >= total - target
            break
    low = [r for r in rows if key(r) < cut or inside and key(r) == cut]
    high = [r for r in rows if key(r) > cut or not inside and key(r) == cut]
    return _plain_kd(low, left, first) | _plain_kd(high, shards - left, first + left)


def test_kd_tree_equals_plain_tree(spark, docs):
    found = kd_sharding.kd_shards(docs, 5).collect()
    assert len(found) == len(ROWS)
    for shard in {r["shard"] for r in found}:
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in found)))
    meta = [r.asDict() for r in kd_sharding.metadata(docs).collect()]
    ids = [r["id_raw"] for r in meta]
    for r in meta:
        r["id_at"] = int((r["id_raw"] - min(ids)) / float(max(1, max(ids) - min(ids))) * (kd_sharding.SPAN - 1))
    shard = _plain_kd(meta, 5)
    want = sorted((r["doc_id"] or -1, r["size"], r["text_crc32"], shard[id(r)]) for r in meta)
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"], r["shard"]) for r in found) == want
    assert {r["text_crc32"] for r in found if r["doc_id"] == 1} == {zlib.crc32(b"Hello there, world.")}


def test_kd_tree_of_nothing(spark):
    assert kd_sharding.kd_shards(spark.createDataFrame([], DOCS), 4).count() == 0


@pytest.mark.parametrize("name, lower", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_word_table_equals_whole_texts(name, lower):
    table = WordTable(public_tokenizers.path(name), "<u4", lower)
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    whole.encode_special_tokens = True
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list(" \n.,'as1Éß́ \t🙂ΣİA"), rng.integers(1, 30))) for _ in range(800)]
    texts += ["", " ", "\n", "x <|endoftext|> y", "\x1ca b", "It's 3.5, isn't it?\nYes.", LONG[:3000]]
    for text, ids in zip(texts, table.encode_many(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("name, lower", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_word_table_learns_many_words_in_a_call(name, lower):
    table = WordTable(public_tokenizers.path(name), "<u4", lower)
    real, calls = table.tokenizer, []

    class Counting:
        def __getattr__(self, call):
            calls.append(call)
            return getattr(real, call)

    table.tokenizer = Counting()
    texts = [" ".join(f"{'xyz'[i % 3]}{i * 7919}q" for i in range(9000)).strip(), "odd <|endoftext|> \u0130stanbul, e\u0301te."]
    found = table.encode_many(texts)
    assert len(calls) < 20  # 64 words in a call made 140 and more
    for text, ids in zip(texts, found):
        assert np.frombuffer(ids, "<u4").tolist() == real.encode(text, add_special_tokens=False).ids


def test_wavelet_file():
    rng = np.random.default_rng(1)
    for n, most in ((1, 1), (1000, 50257), (700_000, 300)):
        ids = rng.integers(0, most, n)
        shard = wavelet.WaveletShard(wavelet.encode_shard(ids, np.array([n])))
        assert (shard.ids() == ids).all()
        for i in {0, n // 3, n - 1}:
            assert shard.access(i) == ids[i]
            assert shard.count(int(ids[i]), i) == int((ids[:i] == ids[i]).sum())
            where = np.flatnonzero(ids == ids[i])
            assert shard.occurrence(int(ids[i]), len(where) - 1) == where[-1]
            assert shard.occurrence(int(ids[i]), len(where)) is None
        assert shard.count(1 << 20) == 0


def _tokens(name, text, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_token_files(spark, docs):
    found = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["start"], r["n_tokens"], r["ids_crc32"])
                   for r in wavelet.token_table(spark, docs, public_tokenizers.path("byte_bpe_50k.json")).collect())
    start, want = 0, []
    for r in sorted(ROWS, key=lambda r: -1 if r[0] is None else r[0]):
        ids = _tokens("byte_bpe_50k.json", r[1], 0)
        want.append((-1 if r[0] is None else r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert found == want
    assert wavelet.token_table(spark, docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_packing(spark, docs):
    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), room=256).collect()
    ids = [(_tokens("word_bpe_49k.json", r[1], 2), r[0]) for r in ROWS]
    want = sorted((d or -1, s, min(256, len(t) - s), zlib.crc32(t[s:s + 256].tobytes()), len(t)) for t, d in ids for s in range(0, len(t), 256))
    assert sorted((p["doc_id"] or -1, p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in pieces) == want
    for s in {p["sequence_id"] for p in pieces}:
        own = sorted((p["offset"], p["length"]) for p in pieces if p["sequence_id"] == s)
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 256
    assert packing.pack_documents(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_first_fit_decreasing_equals_scan():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 101, 500)
    sequence, offset = packing.first_fit_decreasing(lengths, 100)
    room, want = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        k = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
        if k == len(room):
            room.append(100)
        want[i] = k, 100 - room[k]
        room[k] -= lengths[i]
    assert all((sequence[i], offset[i]) == want[i] for i in want)


def test_sequences_hold_all_ids(spark, docs):
    own = docs.filter("doc_id >= 100")
    packed = packing.pack_documents(own, public_tokenizers.path("word_bpe_49k.json"), room=64)
    rows = packing.sequences(own, packed, public_tokenizers.path("word_bpe_49k.json")).collect()
    total = sum(len(_tokens("word_bpe_49k.json", r[1], 2)) for r in ROWS if r[0] and r[0] >= 100)
    assert sum(len(r["ids"]) for r in rows) == total and max(len(r["ids"]) for r in rows) <= 64


def test_urls_cannot_end_their_header_line(spark):
    breaks = ["\n", "\r", "\r\n", "\u0085", "\u2028", "\u2029", "\x00", "\x0b", "\x0c", "\x1f", "\x7f"]
    rows = [(i, f"http://a/{c}X-Page: 77{c}WARC-Type: revisit{c}WARC-Payload-Digest: sha256:{'0' * 64}", "page" * 50) for i, c in enumerate(breaks)]
    rows += [(50, "http://plain/é?a=1%20b", "other" * 50)]
    folder = scratch_path(spark, "test-warc")
    warc_archive.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    for found in (warc_archive.page_digests(spark, folder), warc_archive.read_records(spark, folder)):
        got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_digest"]) for r in found.collect()}
        assert got.keys() == {r[0] for r in rows}
        assert got[0][:2] == ("response", None) and all(got[i][:2] == ("revisit", 0) for i in range(1, len(breaks)))
        assert got[50][2] == hashlib.sha256(rows[-1][2].encode()).hexdigest()
    heads = {r["page_id"]: bytes(r["header"]).decode() for r in warc_archive.read_records(spark, folder).collect()}
    assert "WARC-Target-URI: http://plain/é?a=1%20b\r\n" in heads[50] and "http://a/%E2%80%A8X-Page: 77" in heads[5 - 1]
    assert heads[0].split("WARC-Target-URI: ")[1].startswith("http://a/%0AX-Page: 77%0A")


def test_equal_rows_are_cut_apart(spark):
    rows = [(7, "copy of a text", "en", "a", 1, 0, 0)] * 2000 + [(1000 + i, "x" * (i % 50), "en", "a", 1, 0, 0) for i in range(1000)]
    found = kd_sharding.kd_shards(spark.createDataFrame(rows, DOCS).repartition(5), 8).collect()
    assert len(found) == 3000 and sum(r["doc_id"] == 7 for r in found) == 2000
    sizes = [sum(r["size"] for r in found if r["shard"] == k) for k in range(8)]
    assert max(sizes) - min(sizes) <= 3 * 66  # a row at each of three levels
    for k in range(8):
        assert sorted(r["slot"] for r in found if r["shard"] == k) == list(range(sum(r["shard"] == k for r in found)))


def test_all_rows_equal(spark):
    found = kd_sharding.kd_shards(spark.createDataFrame([ROWS[0]] * 64, DOCS), 4).collect()
    assert sorted(r["shard"] for r in found) == [k for k in range(4) for _ in range(16)]


def test_word_table_takes_known_words_once_and_keeps_them_when_it_starts_anew(monkeypatch):
    """Words that the table has are not gone through to be learned; what was found for them stays when the table is cleared."""
    table = WordTable(public_tokenizers.path("byte_bpe_50k.json"), "<u4", False)
    first = ["a few words, known before\nand after."]
    known, asked, learn = table.encode_many(first), [], table.learn
    monkeypatch.setattr(table, "learn", lambda words: (asked.append(set(words)), learn(words)))
    assert table.encode_many(first) == known and not asked[-1]
    texts = [first[0] + " New\u00e9 ones.", "after that", first[0]]
    monkeypatch.setattr(tokens, "KEPT_WORDS", len(table) + 1)
    found = table.encode_many(texts)
    assert asked[-1] == {" New\u00e9", " ones.", "after", " that"}
    assert len(table) < 9 and found[2] == known[0]
    for text, ids in zip(texts, found):
        assert np.frombuffer(ids, "<u4").tolist() == table.tokenizer.encode(text, add_special_tokens=False).ids


def test_a_worker_holds_one_bounded_word_table():
    from hydroflow.llm import common

    a, b = common.WordHashes(), common.WordHashes(least=3)
    a.most_bytes = 1000
    first = a.of([b"w%d" % i for i in range(100)])
    assert 0 < len(a) < 10 and a.held >= 1000
    assert (a.of([b"w%d" % i for i in range(100)]) == first).all()  # words that are not kept have the same hash
    assert len(b.of([b"x"])) == 1 and len(a) == 0 and a.held == 0
    assert (a.of([b"w1"]) == first[1]).all() and len(b) == 0
