"""Scores, filters, joins and the pipeline against plain versions."""

import collections
import math
import random
import re
import tracemalloc
import types

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hydroflow.llm import backoff_lm, decontamination, ngram_join, quality_llr, quality_qda, toxicity
from hydroflow.llm.common import fold_is, small, squeezed, unsmall, unsqueezed
from hydroflow.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = "anna bernd carla doris emil frida georg heidi ivan julia karl lena".split()
WORDS = ["".join(random.Random(k).choice("abcdefghiklmnoprstuw") for _ in range(3 + k % 6)) for k in range(900)]


def prose(seed, n=120):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = rng.choice(WORDS)
        out.append(w.capitalize() if i % 12 == 0 else w + "." if i % 12 == 11 else w)
    return " ".join(out)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOCS)


def plain_sets(rows):
    out = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def plain_components(rows):
    sets = plain_sets(rows)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d if d is not None else -1, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def near_copy_rows():
    rng, rows = random.Random(4), []
    shared = prose("line", 40)
    for k in range(25):
        base = prose(k, rng.choice([6, 20, 60, 200])).split()
        for _ in range(rng.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 3])):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((len(rows) + 10, " ".join(w) + (" " + shared if k % 3 == 0 else "")))
    return rows + [(1, None), (2, ""), (3, " \n"), (4, "two words"), (5, "TWO  words"), (6, "one"), (7, rows[0][1]), (None, rows[0][1]),
                   (rows[3][0], rows[3][1]), (8, "été ÉTÉ a b c d")]


@pytest.mark.parametrize("chunk, quick", [(500_000, 6), (400, 6), (400, 0)])
def test_near_copies_equal_all_pairs(spark, monkeypatch, chunk, quick):
    monkeypatch.setattr(ngram_join, "CHUNK_SHINGLES", chunk)
    if not quick:  # without quick links the complete search has to find everything
        monkeypatch.setattr(ngram_join, "_quick_members", lambda v: v.limit(0).selectExpr(
            "vertex AS bunch", "row_key", "vertex", "vertex AS class", "true AS stored", "true AS running"))
    rows = near_copy_rows()
    found = ngram_join.near_copies(frame(spark, rows)).collect()
    assert sorted(((r[0] if r[0] is not None else -1, r[1], r[2]) for r in found), key=str) == plain_components(rows)


def test_near_copies_let_shuffle_files_go(spark, monkeypatch):
    write, seen, before = ngram_join.write_and_read, [], spark.conf.get(ngram_join.LET_GO, None)
    monkeypatch.setattr(ngram_join, "write_and_read", lambda *a: (seen.append(spark.conf.get(ngram_join.LET_GO)), write(*a))[1])
    found = ngram_join.near_copies(frame(spark, [(1, "a b c d e f"), (2, "A b c d e f"), (3, None)]))
    assert len(seen) > 5 and set(seen) == {"true"} and spark.conf.get(ngram_join.LET_GO, None) == before
    assert sorted(map(tuple, found.collect())) == [(1, 2, 1), (2, 2, 1), (3, 0, 3)]


def test_shingles_of_pieces_and_long_words(monkeypatch):
    texts = [None, "", " ", "a", "a b", "A  B", "a b c d e f a b c d e f", "é É\x0b\x1c q \x85 z", "x" * 700 + " y " + "z" * 300, "y " * 500, " " * 300 + "q",
             "ab ba abba baab " * 9] + [prose(k, 50) for k in range(20)]

    def plain(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    whole = list(ngram_join.shingle_sets(texts))
    assert [len(s) for s in whole] == [len(plain(t)) for t in texts]
    assert len(np.unique(np.concatenate(whole))) == len(set().union(*map(plain, texts)))
    monkeypatch.setattr(ngram_join, "PIECE_BYTES", 64)  # words are cut off nowhere, and hashes don't depend on where texts stand
    for pieces in (list(ngram_join.shingle_sets(texts)), [ngram_join.shingles(t) for t in texts]):
        assert all((a == b).all() for a, b in zip(pieces, whole, strict=True))


@pytest.mark.parametrize("chunk", [1000, 25])
def test_sets_with_many_common_tokens_meet_once(spark, monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK_SHINGLES", chunk)
    keys = {1: range(6), 2: range(6), 3: [*range(1, 6), 90], 4: [80, 81, 82, 83, 84, 85], 5: [80, 81, 82, 83, 84, 95], 6: range(100, 106)}
    vertices = spark.createDataFrame([(k, 10 + k, 10, list(v)) for k, v in keys.items()], "vertex long, row_key long, n long, keys array<long>")
    members = ngram_join._quick_members(vertices).collect()
    if chunk == 1000:  # six keys each, but at most two bunches around a set of the three that are alike
        assert len(members) <= 2 + 5 and {r["row_key"] for r in members} == {11, 12, 13, 14, 15}
    # the complete search loses no pair, however small chunks are
    rows = [(t, 10 + k, k, k, 10) for k, v in keys.items() for t in v]
    found = ngram_join._bunches(spark.createDataFrame(rows, "token long, row_key long, vertex long, class long, n long"), in_pairs=True).collect()
    met = {tuple(sorted((a["vertex"], b["vertex"]))) for a in found for b in found if a["bunch"] == b["bunch"] and a["vertex"] != b["vertex"]
           and (a["stored"] and b["running"] or b["stored"] and a["running"])}
    assert met >= {(1, 2), (1, 3), (2, 3), (4, 5)}


def test_near_copies_of_nothing(spark):
    assert ngram_join.near_copies(frame(spark, [])).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 300), (300, 100), (7, 7), (500, 501)]
    found = {r["v"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({found[i] for i in range(1, 41)}) == 1 and len({found[100], found[200], found[300]}) == 1 and len(set(found.values())) == 3


def test_base_rules(spark):
    rows = [(1, None), (2, ""), (3, "one"), (4, "a b c a b c a b c"), (5, "x #y |z\n\nx #y |z\n x"), (6, prose(3, 60)), (7, "é b  c\td\x0be"),
            (8, "k l m " * 300), (9, "!a\x0cb\r#c!!\td$ !"), (None, prose(4, 70)), (6, prose(3, 60))]
    trusted = spark.createDataFrame([(6,)], "doc_id long")
    found = quality_llr.likelihood(frame(spark, rows), trusted).collect()

    def want(d, text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        count, covered = collections.Counter(windows), set()
        for i, x in enumerate(windows):
            if count[x] > 1:
                covered |= {i, i + 1, i + 2}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return (d or -1, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
                len(w) < 50 or 100 * len(covered) > 50 * len(w))

    assert sorted((r["doc_id"] or -1, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
                  for r in found) == sorted(want(*r) for r in rows)
    assert not any(r["kept"] and r["base_failed"] for r in found)
    assert quality_llr.likelihood(frame(spark, []), trusted).count() == 0
    assert quality_llr.likelihood(frame(spark, rows), trusted.limit(0)).filter("ratio <> 0").count() == 0


def test_ratio_is_the_mean_weight_of_the_n_grams(spark):
    rows = [(i, prose(i, 20 + i) + (" a#b!" if i % 3 else "")) for i in range(12)] + [(50, "one"), (51, ""), (52, None)]
    docs, trusted = frame(spark, rows), spark.createDataFrame([(i,) for i in range(4)], "doc_id long")
    weights = quality_llr.bucket_weights(docs, trusted)
    spread = quality_llr.with_lists(docs).select("doc_id", F.explode(quality_llr.grams()).alias("bucket")).join(weights, "bucket")
    want = {r["doc_id"]: r["w"] for r in spread.groupBy("doc_id").agg(F.avg("weight").alias("w")).collect()}
    got = {r["doc_id"]: r["ratio"] for r in quality_llr.likelihood(docs, trusted).collect()}
    assert got == pytest.approx({d: want.get(d, 0.0) for d, _ in rows}) and len(want) == 13


def test_likelihood_tells_signs_from_prose(spark):
    rows = [(i, prose(i, 100)) for i in range(60)] + [(100 + i, " ".join(w + "&&&" for w in prose(i, 100).split())) for i in range(30)]
    trusted = spark.createDataFrame([(i,) for i in range(30)], "doc_id long")
    kept = {r["doc_id"]: r["kept"] for r in quality_llr.likelihood(frame(spark, rows), trusted).collect()}
    assert all(kept[i] for i in range(60)) and not any(kept[100 + i] for i in range(30))


def test_discriminant(spark):
    rows = [(i, prose(i, 80 + i % 50)) for i in range(150)] + [(200 + i, prose(i, 90).upper().replace(" ", "!! ")) for i in range(60)]
    rows += [(500, None), (501, ""), (None, "x"), (3, prose(3, 80))]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(200 + i, 0, 0) for i in range(60)] + [(None, 1, 0), (9, None, 0)],
                                   "doc_id long, quality int, toxic int")
    found = quality_qda.score(frame(spark, rows), labels, fold_is("doc_id", 4, 2)).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held_out"] and r["doc_id"] < 500]
    assert held and all((r["score"] >= 0.7) == (r["doc_id"] < 200) for r in held)
    none = quality_qda.score(frame(spark, rows), labels.limit(0), fold_is("doc_id", 4, 2)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality_qda.score(frame(spark, []), labels, fold_is("doc_id", 4, 2)).count() == 0


def test_discriminant_keeps_all_without_both_classes(spark):
    rows = [(i, prose(i, 80)) for i in range(20)] + [(None, None)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        assert quality_qda.keep(docs, known, fold_is("doc_id", 4, 2), 0.7).count() == 21


def test_grammar_reads_clauses():
    g = toxicity.Grammar({"idiot": 6.0, "lowe-": 5.0}, {}, 0.02)
    assert g.score(None) == g.score("") == g.score("a quiet text") == pytest.approx(0.02)
    assert g.score("You idiot! Go away.") > g.score("an idiot") > 0.7
    assert g.score("he said idiot") < g.score("an idiot") and g.score("he is not an idiot") < 0.7
    assert g.score("the loweish thing") > 0.7 and g.score("I will kill you") == pytest.approx(0.02)
    assert g.score("you I kill") > 0.7
    assert g.matches("You are not an idiot. Idiot")[0][0] == ("insult", True, True, False)
    assert len(toxicity.CLASSES) == 12


def test_threats_and_insults_with_the_target_after_them():
    g = toxicity.Grammar({"idiot": 6.0}, {}, 0.02)
    for text in ("I will kill you", "kill them all", "he will beat her up", "They stabbed him", "killing you slowly", "Ich töte dich",
                 "je vais tuer ta famille", "voy a matarte", "you I kill"):
        assert g.score(text) > 0.7, text
    assert g.matches("an idiot like you")[0][0] == ("insult", True, False, False)
    assert g.matches("what an idiot. You there")[0][0] == ("insult", False, False, False)
    assert g.matches("I will not kill you")[0][0] == ("threat", True, True, False)
    for text in ("kill the process", "kill one two three four you", "I beat eggs. You stir"):
        assert g.score(text) == pytest.approx(0.02), text
    assert len(toxicity.CLASSES) == 12


def test_toxic_words_next_to_signs_and_in_few_documents(spark):
    g = toxicity.Grammar({"idiot": 6.0, "moron": 6.0}, {}, 0.02)
    for text in ("go away!idiot", "stop.moron;x", "so\tit?idiot"):
        assert g.matches(text) and g.score(text) > 0.7, text
    texts = [("so vilno then vilno and vilno go.vilno", 1)] * 3 + [("a quiet text", 0)] * 3
    rows = spark.createDataFrame(texts, "text string, label int").coalesce(1)
    counts = {r["unit"]: r for r in rows.mapInPandas(toxicity._count_units, "unit string, clean long, toxic long, contexts array<long>").collect()}
    assert counts["vilno"]["toxic"] == 3 and len(counts["vilno"]["contexts"]) >= 3 and "go.vilno" not in counts


def test_toxicity_learns(spark):
    rng, rows, labels = random.Random(2), [], []
    for i in range(400):
        w = prose(i, 60).split()
        if i % 5 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vilno", "grubak", "smerto"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 5 == 0)))
    extra = [(900, None), (901, ""), (None, "vilno"), (0, rows[0][1])]
    table = spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    found = toxicity.score(frame(spark, rows + extra), table, fold_is("doc_id", 3, 1)).collect()
    assert len(found) == 404
    held = [r for r in found if r["held_out"] and r["doc_id"] < 400]
    assert held and all((r["score"] >= 0.7) == (r["doc_id"] % 5 == 0) for r in held)
    assert toxicity.score(frame(spark, []), table, fold_is("doc_id", 3, 1)).count() == 0
    assert all(0 <= r["score"] < 0.7 for r in toxicity.score(frame(spark, rows[:5]), table.limit(0), fold_is("doc_id", 3, 1)).collect())
    kinds = toxicity.clause_matches(frame(spark, [(1, "you vilno")]), toxicity.Grammar({"vilno": 5.0}, {}, 0.0)).collect()
    assert [(r["kind"], r["targeted"]) for r in kinds] == [("insult", True)]


ITEM = "On Monday morning Anna Smith bought 12 kg of apples at the market near the old bridge, and later Anna Smith sold 5 kg of them to Boris again."


def test_decontamination(spark):
    other = ITEM.replace("Anna Smith", "Maria Jones").replace("12", "37").replace(" 5 ", " 9 ").replace("Boris", "Peter")
    uneven = ITEM.replace("later Anna Smith", "later Maria Jones").replace("12", "37")
    items = spark.createDataFrame([(1, ITEM, "x"), (2, None, "x"), (3, "", "x"), (4, "short little item of plain words", "x"), (1, ITEM, "x")],
                                  "item_id long, text string, doc_id string")
    rows = [(1, prose(1) + " " + ITEM + " " + prose(2)), (2, prose(3) + " " + other), (3, prose(4, 200)), (4, None), (5, ""),
            (6, "before short little item of plain words after"), (7, ITEM.lower()), (None, ITEM), (1, prose(1) + " " + ITEM + " " + prose(2)),
            (8, " ".join(ITEM.split()[:10]) + " " + prose(5)), (9, uneven)]
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(frame(spark, rows), items).collect()}
    assert found >= {(1, 1), (2, 1), (6, 4), (7, 1)}
    assert found <= {(1, 1), (2, 1), (6, 4), (7, 1), (9, 1)}
    assert sorted(r["doc_id"] or -1 for r in decontamination.clean_documents(frame(spark, rows), items).collect() if r["doc_id"] != 9) == [-1, 3, 4, 5, 8]
    assert decontamination.contaminated(frame(spark, []), items).count() == 0
    assert decontamination.contaminated(frame(spark, rows), items.limit(0)).count() == 0


def test_decontamination_judges_each_passage(spark):
    a = ITEM.replace("12", "37").replace(" 5 ", " 9 ")
    b = ITEM.replace("12", "40").replace(" 5 ", " 8 ").replace("Anna Smith", "Maria Jones")
    same = ITEM.replace("12", "7").replace(" 5 ", " 7 ")
    stray = "bought 99 kg of apples at the market near"
    short = "He gave 3 of the red balls and 4 of the blue balls away"
    items = spark.createDataFrame([(1, ITEM), (2, short)], "item_id long, text string")
    rows = [(1, a + " " + prose(1) + " " + b), (2, prose(2) + " " + a + " " + prose(3) + " " + stray), (3, same), (4, prose(4) + " " + stray),
            (5, a + " " + b), (6, short.replace("3", "5").replace("4", "5")),
            (7, short.replace("3", "5").replace("4", "6") + " " + prose(5) + " " + short.replace("3", "8").replace("4", "9"))]
    found = {(r["doc_id"], r["item_id"]): r["windows_found"] for r in decontamination.contaminated(frame(spark, rows), items).collect()}
    assert set(found) == {(1, 1), (2, 1), (3, 1), (5, 1), (6, 2), (7, 2)}


def test_decontamination_judges_windows_at_one_place_once(spark):
    """A passage that many documents hold goes to one passage per document, not to each number about its place."""
    rows = [(d, 7, 40 * d) for d in range(1, 30) for _ in range(20)] + [(50, 7, s) for s in (0, 3, 10, 90)] + [(51, 7, s) for s in (5, 9)]
    found = decontamination.passages(spark.createDataFrame(rows, "doc_id long, item_id long, shift int")).collect()
    assert len(found) == len(set(found))
    places = collections.defaultdict(set)
    for r in found:
        places[r["doc_id"], r["first"], r["last"]].add(r["shift"])
    assert {k: v for k, v in places.items() if k[0] < 50} == {(d, 40 * d, 40 * d): {40 * d} for d in range(1, 30)}
    assert {k[1:]: v for k, v in places.items() if k[0] == 50} == {
        (0, 0): {0}, (0, 3): {0, 3}, (3, 3): {3}, (3, 10): {3, 10}, (10, 10): {10}, (90, 90): {90}, (0, 90): {0, 3, 10, 90}}
    assert {k[1:]: v for k, v in places.items() if k[0] == 51} == {(5, 5): {5}, (5, 9): {5, 9}, (9, 9): {9}}


def test_decontamination_counts_windows_of_a_long_item(spark):
    text = prose(31, 200).lower()
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    words = text.split()
    rows = [(1, text), (2, " ".join(words[:150])), (3, " ".join(words[60:80])), (4, text + " " + text), (4, text)]
    found = {r["doc_id"]: (r["windows_found"], r["n_windows"]) for r in decontamination.contaminated(frame(spark, rows), items).collect()}
    assert found == {1: (193, 193), 2: (143, 193), 3: (13, 193), 4: (193, 193)}


def test_decontamination_reads_names_and_dense_numbers(spark):
    tom = "Tom has 5 apples. Tom eats 3. How many apples does Tom have?"
    begins = "Tom bought 5 red apples and some pears. Tom ate 3 of them at noon. How many are left now?"
    trip = "In the summer Anna went from Boston by the slow train to see her old aunt"
    hours = "The clock of the tower struck twenty-five times before noon and then it stopped"
    dense = "Add 3 4 5 and 6 7 8 then take 2 1 9 from 12 13 14 to get 5 6 7 of them"
    items = spark.createDataFrame(list(enumerate([tom, begins, trip, hours, dense])), "item_id long, text string")
    rows = [(0, tom.replace("Tom", "Anna").replace("5", "7").replace("3", "2")), (1, begins.replace("Tom", "Mary Ann").replace("5", "8").replace("3", "6")),
            (2, trip.replace("Anna", "Mary Ann Smith").replace("Boston", "New York")), (3, hours.replace("twenty-five", "forty-two")),
            (4, "".join(str((int(c) + 3) % 10) if c.isdigit() else c for c in dense)), (5, prose(9))]
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(frame(spark, [(d, prose(20 + d) + " So. " + t) for d, t in rows]), items).collect()}
    assert found == {(k, k) for k in range(5)}


def test_gram_rows_open_texts_without_a_function_per_token(spark):
    lists = [[], ["a"], ["a", "b"], ["a", "b", "a", "b", "é"], ["x"] * 7]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(lists)], "k int, tokens array<string>")
    opened = quality_llr.gram_rows(rows)
    assert "lambda" not in opened._jdf.queryExecution().toString()
    hashed = {g: spark.range(1).select(F.xxhash64(*[F.lit(x) for x in g]).bitwiseAND(quality_llr.BUCKETS - 1)).first()[0]
              for t in lists for g in [*zip(t), *zip(t, t[1:])]}
    want = sorted((i, hashed[g]) for i, t in enumerate(lists) for g in [*zip(t), *zip(t, t[1:])])
    assert sorted(map(tuple, opened.collect())) == want


def test_backoff_scores(spark, monkeypatch):
    monkeypatch.setattr(backoff_lm, "BLOCK_TOKENS", 700)
    rows = [(i, prose(i % 40, 70) + (" Extra" if i % 3 else "")) for i in range(90)] + [(200, None), (201, ""), (202, "unheard of ÉTÉ"), (None, "no id here"), (3, "twice")]
    found = backoff_lm.score(frame(spark, rows), fold_is("doc_id", 5, 1)).collect()
    assert len(found) == len(rows)
    held = {r["doc_id"]: r["held_out"] for r in found}
    texts = [(d, (["<b>"] + re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["<e>"])) for d, t in rows]
    train = [w for d, w in texts if not held[d]]
    c1 = collections.Counter(x for w in train for x in w[1:])
    c2 = collections.Counter(p for w in train for p in zip(w, w[1:]))
    n, v = sum(c1.values()), len(c1)
    ones = lambda c, k: sum(x == k for x in c.values())
    d1 = min(0.9, max(0.1, ones(c1, 1) / v))
    d2 = min(0.95, max(0.1, ones(c2, 1) / max(1, ones(c2, 1) + 2 * ones(c2, 2))))
    c1["<b>"] = len(train)
    kept = {p: k for p, k in c2.items() if k >= 2}
    mass = collections.defaultdict(float)
    for (h, _), k in kept.items():
        mass[h] += k - d2
    single = lambda w: (c1[w] - d1) / n if c1[w] else d1 * v / n
    left = lambda h: 1 - mass[h] / c1[h] if c1[h] else 1.0
    assert sum(single(w) for w in c1 if w != "<b>") + d1 * v / n == pytest.approx(1)
    want = []
    for d, w in texts:
        base = sum(math.log10((c1[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w[1:])
        score = sum(math.log10((kept[h, x] - d2) / c1[h] + left(h) * single(x) if (h, x) in kept else left(h) * single(x)) for h, x in zip(w, w[1:]))
        want.append((d or -1, len(w) - 1, sum(c1[x] > 0 for x in w[1:]), n, base, score))
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in found)
    for a, b in zip(got, sorted(want)):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=1e-6)
    assert backoff_lm.score(frame(spark, []), fold_is("doc_id", 5, 1)).count() == 0


def test_backoff_blocks_open_few_texts_at_a_time(tmp_path, monkeypatch):
    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: types.SimpleNamespace(partitionId=lambda: 0)))
    texts = ["x" * 20_000] * 1500 + [None, "a b a b c"]
    batch = pa.RecordBatch.from_pydict({"doc_id": [*range(1501), None], "text": texts, "held_out": [False] * 1502})
    tracemalloc.start()
    rows = [r for b in backoff_lm._count_blocks(str(tmp_path), 4)(iter([batch])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16_000_000  # all texts take 30 MB
    block = backoff_lm.Block.read((tmp_path / rows[0]["block"]).read_bytes())
    assert len(block["ends"]) == 1502 and block["no_id"].tolist() == [False] * 1501 + [True]
    # steps of "a b a b c <end>" against a walk that takes an arc or fails to the empty state
    pairs = np.arange(len(block["heads"])) % 3
    counts, ones = np.full(len(block["words"]), 5), np.ones(len(block["words"]))
    automaton = backoff_lm.Automaton(block, counts, ones, 3 * ones, pairs, {"tokens": 50, "types": 9, "word_discount": 0.5, "pair_discount": 0.4})
    single, left = (5 - 0.5) / 50, 1 - (3 - 0.4) / 5
    walk = [math.log10((2 - 0.4) / 5 + left * single) if pairs[p] == 2 else math.log10(left) + math.log10(single) for p in block["pair_of"][-6:]]
    assert automaton.score(block["pair_of"], block["ends"])[-1] == pytest.approx(sum(walk), abs=1e-9)


def test_backoff_blocks_send_bigrams_without_their_first_words():
    rng = np.random.default_rng(9)
    block = backoff_lm.Block([1, 2], [False, True], [rng.integers(3, 1 << 62, 3_000, np.uint64)[rng.integers(0, 3_000, 20_000)] for _ in range(2)])
    sent = block.segments("b", 64)
    for kind, entries in (("word", len(block.words)), ("pair", len(block.heads))):
        rows = sent[sent["kind"] == kind]
        assert sum(len(v) for c in rows.columns for v in rows[c] if isinstance(v, bytes)) == 12 * entries  # a key and a count each
    assert sorted(np.concatenate([unsqueezed(b) for b in sent[sent["kind"] == "pair"]["keys"]])) == sorted(backoff_lm._pair_keys(block.words, block.heads, block.tails))


def test_backoff_kept_bigrams_have_one_owner():
    keys = [np.array(k, np.uint64) for k in ([5, 7, 9], [5, 9, 11], [9, 12])]
    counts = [np.array(c) for c in ([1, 1, 0], [1, 3, 1], [2, 0])]
    frame = pd.DataFrame({"kind": "pair", "block": ["a", "b", "c"], "bucket": 0, "keys": list(map(squeezed, keys)), "counts": list(map(small, counts))})
    found = backoff_lm._add_up(frame)
    answers = found[found["kind"] == "pair"]
    assert [unsmall(b).tolist() for b in answers["counts"]] == [[2, 1, 5], [2, 5, 1], [5, 0]]
    owned = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(k)).astype(bool) for b, k in zip(answers["sums"], keys)]
    assert sorted(np.concatenate([k[o] for k, o in zip(keys, owned)]).tolist()) == [5, 9]
    assert found[found["kind"] == "sums pair"][["total", "types", "ones", "twos"]].values.tolist() == [[9, 4, 2, 1]]


def test_pipeline(spark, tmp_path):
    copy = prose(1, 150).split()
    near = " ".join(copy[:70] + ["changed"] + copy[71:])
    bench = prose("bench", 30)
    rows = [(i, prose(i, 150)) for i in range(1, 160)] + [(300, near), (301, prose(2, 150)), (302, prose(500, 90) + " " + bench)]
    rows += [(400 + i, prose(600 + i, 90).upper().replace(" ", "!! ")) for i in range(40)]
    toxic = [(500 + i, " vilno ".join([prose(700 + 4 * i + k, 30) for k in range(4)])) for i in range(40)]
    frame(spark, rows + toxic).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(d, 0 if 400 <= d < 500 else 1, int(d >= 500)) for d, _ in rows + toxic if d < 300 or d >= 400]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in found} == set(range(1, 160))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "n-gram Jaccard join", "benchmark decontamination", "packing"]


def test_pipeline_stages_with_repeated_and_null_ids(spark, tmp_path):
    near = " ".join(prose(1, 150).split()[:140])
    rows = [(1, prose(1, 150)), (1, prose(1, 150)), (1, prose(2, 80)), (2, near), (2, prose(3, 90)), (None, prose(1, 150)), (None, near),
            (None, prose(4, 70)), (None, prose(4, 70)), (5, ""), (5, ""), (None, None), (6, prose(6, 40)), (7, prose(7, 40)), (7, prose(6, 40))]
    left = corpus_pipeline.copies_out(spark, frame(spark, rows), str(tmp_path))
    want = [rows[k] for k in (0, 2, 4, 7, 9, 10, 11, 12, 13)]
    assert left.columns == frame(spark, rows).columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted(want, key=str)
    bench = prose("bench", 30)
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, prose(1) + " " + bench), (None, prose(2)), (3, prose(3) + " " + bench), (3, prose(4)), (5, None)]
    left = corpus_pipeline.benchmark_out(spark, frame(spark, rows), str(tmp_path))
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)


def test_statistics_of_odd_texts():
    for text in (None, "", " \n", "x", "é" * 100_000, "a b " * 50_000):
        assert np.isfinite(quality_qda.statistics(text)).all()


def test_templates_of_many_texts_are_those_of_each(monkeypatch):
    texts = [None, "", "Tom has 5 apples. -- Tom eats 3 km\nkm 12kg of five-mile New York. New\nYork! ... it", "km 7", "\n\n", "km " + prose(7, 3000), "Ann 8"]
    kinds = {decontamination.LITERAL: "", decontamination.OF_NUM: "num", decontamination.OF_UNIT: "unit", decontamination.OF_NAME: "name",
             decontamination.MAYBE: "maybe", decontamination.OF_NAME + decontamination.GOES_ON: "name+"}

    def read(many):
        t = decontamination.template(many)
        rows = [(t.plain[n], int(h), kinds[k]) for n, h, k in zip(t.numbers.tolist(), t.hashes, t.types.tolist())]
        return [rows[a:b] for a, b in zip(t.edges[:-1], t.edges[1:])]

    def windows(many):
        r = decontamination._read(many, [3, 8])
        return sorted((int(r.text[a]), int(h), int(r.places[a]), int(s), *r.fillers(x.slots, a, b))
                      for x in r.found for h, a, b, s in zip(x.hashes, x.starts.tolist(), x.ends.tolist(), x.sizes))

    for most_bytes in (96_000_000, 500):  # a table that holds all words, one that is full at once
        monkeypatch.setattr(decontamination, "_SEEN", decontamination._Words(most_bytes))
        whole = read(texts)
        assert whole == [read([t])[0] for t in texts]
        assert windows(texts) == sorted((i, *w[1:]) for i, t in enumerate(texts) for w in windows([t]))
        assert [(w, k) for w, _, k in whole[2]] == [
            ("tom", "maybe"), ("has", ""), ("5", "num"), ("apples", ""), ("tom", "maybe"), ("eats", ""), ("3", "num"), ("km", "unit"), ("km", ""),
            ("12", "num"), ("kg", "unit"), ("of", ""), ("five", "num"), ("mile", "unit"), ("new", "name"), ("york", "name+"), ("new", "maybe"),
            ("york", "maybe"), ("it", "")]
        assert [(w, k) for w, _, k in whole[3]] == [("km", ""), ("7", "num")] and len(whole[5]) == 3001
    assert whole[0] == whole[1] == whole[4] == []


def test_filters_keep_columns_of_any_name(spark):
    bench = prose("bench", 30)
    rows = [(1, prose(1, 150)), (2, prose(1, 150)), (2, prose(1, 150)), (3, prose(3, 60) + " " + bench), (4, ""), (None, prose(5, 60)), (None, prose(1, 150))]
    names = ["_key", "_tie", "_row", "_told", "_stays", "_place", "_bad_id", "root", "n", "row_key", "signature", "a.b", "k"]
    docs = spark.createDataFrame([(d, t, *[f"{i} {c}" for c in names]) for i, (d, t) in enumerate(rows)],
                                 "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    given = {(r["doc_id"], r["text"]): {tuple(x) for x in docs.collect() if (x["doc_id"], x["text"]) == (r["doc_id"], r["text"])} for r in docs.collect()}
    items = spark.createDataFrame([(1, bench)], "item_id long, text string")
    for left, want in ((ngram_join.without_copies(docs), [1, 3, 4, None]), (decontamination.clean_documents(docs, items), [1, 2, 2, 4, None, None])):
        assert left.columns == docs.columns
        found = left.collect()
        assert sorted(map(str, (r["doc_id"] for r in found))) == sorted(map(str, want))
        assert all(tuple(r) in given[r["doc_id"], r["text"]] for r in found)


def test_items_without_an_id_clean_documents(spark):
    first, second = prose("bench", 30), prose("other", 30)
    items = spark.createDataFrame([(None, first), (None, first), (None, None), (7, second), (7, second)], "item_id long, text string")
    docs = frame(spark, [(1, prose(1, 60) + " " + first), (2, prose(2, 60)), (3, prose(3, 60) + " " + second), (4, None)])
    assert sorted(r["doc_id"] for r in decontamination.clean_documents(docs, items).collect()) == [2, 4]
    assert [(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, items).collect()] == [(3, 7)]
