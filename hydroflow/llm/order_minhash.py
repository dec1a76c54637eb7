"""Order MinHash fingerprints: minimal occurrence-numbered k-mers, kept in text order and hashed as tuples.

A text's k-mers are its pairs of neighbouring words, with one mark before the first and after the last word, so every
text has one at least. Equal k-mers are numbered in text order, and each (k-mer, number) is hashed once. The upper bits
of the hash choose one of ``BINS`` sketches, the lower bits order a sketch's k-mers. A sketch selects its ``TUPLE``
smallest, puts them back into text order and hashes the tuple. Two texts agree in a sketch if they have the same
smallest k-mers in the same order, which moved words break although the set of words is the same.

The likeness of two fingerprints is the share of sketches with equal tuples among those that either text fills.

All of it is arrays of numbers inside a row, so a long text is only a longer row and no k-mer is shuffled. Texts meet
the next document's text by row number: rows are numbered in a table without texts, then texts are shuffled twice,
once whole and once as the part that the document before needs.

Defined results: a null text is empty; texts without words have the one k-mer of the two marks, so all of them are
alike; ids are ordered with nulls last and equal ids by their place in the input, each row is a document; the only row
of a table is its own next document; an empty table has no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroflow.llm.common import WORD_GAP, write_and_read
from hydroflow.llm.ordering import written_in_order

#: Sketches of a fingerprint, and k-mers that one selects.
BIN_BITS = 6
BINS = 1 << BIN_BITS
TUPLE = 2
#: A number holds a hash of so many bits above a place in the text of so many bits (words of one text).
HASH_BITS = 37
PLACE_BITS = 26
#: Bits of a tuple's hash that a fingerprint keeps.
SIGN_BITS = 16


def _low(x: Column, bits: int) -> Column:
    return x.bitwiseAND(F.lit((1 << bits) - 1))


def _hash_at(hashed: Column, place: Column) -> Column:
    return F.shiftleft(_low(hashed, HASH_BITS), PLACE_BITS).bitwiseOR(place)


def _sketch(x: Column) -> Column:
    return F.shiftright(x, PLACE_BITS + HASH_BITS - BIN_BITS)


def with_fingerprint(docs: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: an array with one number, sketch and tuple hash, for each sketch that the text fills, in order.

    Each step is a column of its own, because the functions that take several elements read it for every element.
    """
    keep = docs.columns
    words = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), WORD_GAP), "")
    docs = docs.withColumn("_words", F.concat(F.array(F.lit(" ")), words, F.array(F.lit(" "))))
    n = F.size("_words") - 1
    pairs = F.transform(F.slice("_words", F.lit(1), n), lambda w, i: _hash_at(F.xxhash64(w, F.get("_words", i + 1)), i))
    docs = docs.select(*keep, F.sort_array(pairs).alias("_pairs"))
    pair = lambda i: F.shiftright(F.get("_pairs", i), PLACE_BITS)
    n = F.size("_pairs")
    docs = docs.withColumn("_firsts", F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (pair(i) != pair(i - 1))))
    runs = F.transform("_firsts", lambda a, j: F.sequence(F.lit(0), F.coalesce(F.get("_firsts", j + 1), n) - 1 - a))
    number = F.when(F.size("_firsts") == n, F.array_repeat(F.lit(0), n)).otherwise(F.flatten(runs))
    numbered = F.zip_with("_pairs", number, lambda x, o: _hash_at(F.xxhash64(F.shiftright(x, PLACE_BITS), o), _low(x, PLACE_BITS)))
    docs = docs.select(*keep, F.sort_array(numbered).alias("_kmers"))
    least = F.filter("_kmers", lambda x, i: (i < TUPLE) | (_sketch(F.get("_kmers", i - TUPLE)) != _sketch(x)))
    docs = docs.select(*keep, least.alias("_least"))
    at = lambda i: _sketch(F.get("_least", i))
    heads = F.filter(F.sequence(F.lit(0), F.size("_least") - 1), lambda i: (i == 0) | (at(i) != at(i - 1)))

    def sign(i: Column) -> Column:
        own = F.filter(F.slice("_least", i + 1, F.lit(TUPLE)), lambda x: _sketch(x) == at(i))
        in_text = F.sort_array(F.transform(own, lambda x: F.shiftleft(_low(x, PLACE_BITS), HASH_BITS).bitwiseOR(F.shiftright(x, PLACE_BITS))))
        hashed = _low(F.xxhash64(F.transform(in_text, lambda x: _low(x, HASH_BITS))), SIGN_BITS)
        return F.shiftleft(at(i), SIGN_BITS).bitwiseOR(hashed).cast("int")

    return docs.select(*keep, F.transform(heads, sign).alias(out))


def as_text(signs: str) -> Column:
    """A fingerprint as lower-case hex digits, six for each sketch that is filled."""
    digits = (BIN_BITS + SIGN_BITS + 3) // 4
    return F.array_join(F.transform(signs, lambda x: F.lpad(F.lower(F.hex(x)), digits, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Sketches with equal tuples over sketches that either fingerprint fills."""
    filled = lambda c: F.transform(c, lambda x: F.shiftright(x, SIGN_BITS))
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(filled(a), filled(b)))


def edited_fingerprints(docs: DataFrame, from_files: bool = False) -> DataFrame:
    """Fingerprints of each text and of the text whose second half is the next document's beginning.

    ``from_files`` says that ``docs`` is a table read from files as it is, whose rows have a fixed file and place;
    other frames are written first.
    """
    docs = docs.select("doc_id", "text")
    docs = docs if from_files else write_and_read(docs, "documents-in-files")
    rows = docs.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"), "doc_id",
                       F.coalesce("text", F.lit("")).alias("text"))
    light = rows.select("doc_id", "file", "place", F.floor(F.length("text") / 2).cast("int").alias("half"))
    order = [F.asc_nulls_last("doc_id"), F.col("file"), F.col("place")]
    ranked, n = written_in_order(light, order, "documents-in-order")
    follow = ranked.select(((F.col("rank") + (n - 1)) % F.lit(max(n, 1))).alias("rank"), F.col("file").alias("next_file"),
                           F.col("place").alias("next_place"))
    pairs = ranked.select("rank", F.col("file").alias("own_file"), F.col("place").alias("own_place"), "half").join(follow.hint("merge"), "rank")
    pairs = pairs.select(F.col("next_file").alias("file"), F.col("next_place").alias("place"), "own_file", "own_place", "half")
    texts = with_fingerprint(rows, "text", "signs")
    # both joins read one shuffle of the texts
    beginnings = texts.join(pairs.hint("merge"), ["file", "place"]).select(
        F.col("own_file").alias("file"), F.col("own_place").alias("place"), "half", F.col("doc_id").alias("next_doc_id"),
        F.expr("left(text, half)").alias("beginning"), F.col("signs").alias("next_signs"))
    both = texts.join(beginnings.hint("merge"), ["file", "place"])
    both = both.withColumn("n_chars", F.length("text").cast("long"))
    both = both.withColumn("edited", F.concat(F.expr("left(text, int(n_chars) - half)"), F.col("beginning")))
    both = with_fingerprint(both.drop("text", "beginning", "file", "place"), "edited", "edited_signs")
    return both.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), as_text("signs").alias("fingerprint"),
        as_text("edited_signs").alias("edited_fingerprint"), likeness("signs", "edited_signs").alias("near_edited"),
        likeness("signs", "next_signs").alias("near_next"), "next_doc_id")
