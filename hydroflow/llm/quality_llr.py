"""Quality rules and a hashed n-gram likelihood ratio, all in SQL functions.

Words are counted as they stand; for the ratio, signs are tokens of their own. Unigrams and bigrams of tokens are hashed into
a fixed number of buckets, and two multinomials over the buckets are counted: of trusted documents, and of all
documents. A text's ratio is the sum over its n-grams of log(trusted / raw), divided by their number; a
text is kept if the ratio reaches a fixed threshold and the base rules hold. Every document is
judged by the same sums, in the order of its words, nothing is sampled, and the only table sent around is that of the
bucket weights, a list of ``BUCKETS`` numbers.

Defined results: a null or empty text has no words, fails the base rules and is not kept; a text without
n-grams has ratio 0; without trusted documents the ratio is 0 everywhere; rows with equal or null ids are kept, each
judged on its own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroflow.llm.common import write_and_read
from hydroflow.llm.quality_qda import labels_of

#: Buckets of the hashed n-grams; a power of two.
BUCKETS = 1 << 14
#: Added to every bucket's count.
PRIOR = 1.0
#: Ratios below this are not kept.
THRESHOLD = -0.15
LEAST_WORDS = 50
SYMBOLS = "#*$%&|<>"
#: Signs that become tokens of their own.
SIGNS = SYMBOLS + "!"
GAPS = " \t\n\x0b\x0c\r"


def _words(text: Column) -> Column:
    """Words of a text: all white space becomes a space, at which a split needs no pattern."""
    for c in GAPS[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def with_lists(docs: DataFrame) -> DataFrame:
    """doc_id, text, number of symbols, words, tokens and lines with a word."""
    text = F.coalesce("text", F.lit(""))
    spaced = text
    for c in SIGNS:
        spaced = F.replace(spaced, F.lit(c), F.lit(f" {c} "))
    rows = docs.select("doc_id", text.alias("text"), spaced.alias("spaced"), *[c for c in docs.columns if c == "trusted"])
    # a sign adds two spaces; those that are no symbols are counted by taking them out
    size = F.octet_length("text")
    others = sum((size - F.octet_length(F.replace("text", F.lit(c), F.lit(""))) for c in SIGNS if c not in SYMBOLS), F.lit(0))
    symbols = F.expr("(octet_length(spaced) - octet_length(text)) div 2") - others
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(GAPS)) != "")
    words = _words(F.col("text"))
    tokens = F.when(F.col("spaced") == F.col("text"), words).otherwise(_words(F.col("spaced")))  # most texts have no sign
    return rows.withColumns({"n_symbols": symbols.cast("long"), "words": words, "tokens": tokens, "lines": lines}).drop("spaced")


def base_columns(rows: DataFrame) -> DataFrame:
    """Add the base counts of every text.

    Words in repeated windows: hashes of all windows are compared as a set first; only texts with a
    repeated window sort them, with their places, to find the places that are covered.
    """
    n = F.size("words")
    rows = rows.withColumn("windows", F.expr(
        "if(size(words) < 3, array(), transform(sequence(2, size(words) - 1), i -> xxhash64(words[i - 2], words[i - 1], words[i])))"))
    rows = rows.withColumn("sorted", F.expr(
        "if(size(array_distinct(windows)) = size(windows), null, array_sort(transform(windows, (h, i) -> struct(h, i))))"))
    rows = rows.withColumn("places", F.expr("""
        if(sorted IS NULL, null, array_sort(transform(
            filter(sorted, (x, j) -> x.h = get(sorted, j - 1).h OR x.h = get(sorted, j + 1).h), x -> x.i)))"""))
    covered = F.expr("if(places IS NULL, 0, aggregate(transform(places, (p, k) -> least(3, coalesce(get(places, k + 1) - p, 3))), 0, (a, x) -> a + x))")
    return rows.select(
        "doc_id", "tokens", n.cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"))


def grams(tokens: str = "tokens") -> Column:
    """Buckets of a text's unigrams and bigrams."""
    mask = BUCKETS - 1
    return F.expr(f"""if(size({tokens}) < 2, transform({tokens}, t -> cast(xxhash64(t) & {mask} as int)),
        concat(transform({tokens}, t -> cast(xxhash64(t) & {mask} as int)),
               transform(sequence(1, size({tokens}) - 1), i -> cast(xxhash64({tokens}[i - 1], {tokens}[i]) & {mask} as int))))""")


def gram_rows(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """The other columns and ``bucket``, a row per unigram and bigram of a text.

    A text is opened into its tokens, each beside the next one, and hashed there: no step runs a function per array element.
    """
    mask = BUCKETS - 1
    others = [f"`{c}`" for c in rows.columns if c != tokens]
    pairs = rows.selectExpr(*others, f"inline(arrays_zip({tokens}, slice({tokens}, 2, greatest(size({tokens}), 1)))) AS (_token, _next)")
    both = f"array(cast(xxhash64(_token) & {mask} as int), if(_next IS NULL, null, cast(xxhash64(_token, _next) & {mask} as int)))"
    return pairs.selectExpr(*others, f"explode({both}) AS bucket").filter("bucket IS NOT NULL")


def bucket_weights(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """bucket, weight: the logarithm of trusted share over raw share, at most ``BUCKETS`` rows.

    N-grams are counted where they are read: at most one row per task and bucket is shuffled.
    """
    known = trusted.select(F.col("doc_id").alias("known_id")).distinct().withColumn("trusted", F.lit(1))
    # Always a sort-merge join: labels grow with the documents, and a plan that changes with their size is no help.
    marked = docs.select("doc_id", "text").join(known.hint("merge"), F.col("doc_id") == F.col("known_id"), "left")
    counts = write_and_read(gram_rows(with_lists(marked).select("trusted", "tokens")).groupBy("bucket").agg(
        F.count("*").alias("raw"), F.coalesce(F.sum("trusted"), F.lit(0)).alias("good")), "bucket-counts")
    all_raw, all_good = counts.agg(F.sum("raw"), F.sum("good")).first()
    if not all_good:
        return counts.select("bucket", F.lit(0.0).alias("weight"))
    share = lambda c, total: (F.col(c) + PRIOR) / (total + PRIOR * BUCKETS)
    return counts.select("bucket", F.log(share("good", all_good) / share("raw", all_raw)).alias("weight"))


def weight_list(weights: DataFrame) -> str:
    """The weights as a constant of the plan, in the order of the buckets; 0 where there is none."""
    known = dict(weights.collect())  # at most BUCKETS rows
    return f"from_json('{[known.get(b, 0.0) for b in range(BUCKETS)]}', 'array<double>')"


def gram_sum(weights: str, tokens: str = "tokens") -> Column:
    """The sum of the weights of a text's unigrams and bigrams."""
    mask = BUCKETS - 1
    ones = f"aggregate({tokens}, 0D, (a, t) -> a + get({weights}, cast(xxhash64(t) & {mask} as int)))"
    return F.expr(f"""if(size({tokens}) < 2, {ones}, aggregate(sequence(1, size({tokens}) - 1), {ones},
        (a, i) -> a + get({weights}, cast(xxhash64({tokens}[i - 1], {tokens}[i]) & {mask} as int))))""")


def likelihood(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, base counts, ratio, base_failed and kept of every document."""
    weights = weight_list(bucket_weights(docs, trusted))
    scored = base_columns(with_lists(docs)).withColumn("n_grams", F.greatest(F.size("tokens"), 2 * F.size("tokens") - 1))
    scored = scored.withColumn("ratio", F.when(F.col("n_grams") > 0, gram_sum(weights) / F.col("n_grams")).otherwise(F.lit(0.0)))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio",
                         failed.alias("base_failed"), (~failed & (F.col("ratio") >= THRESHOLD)).alias("kept"))


def trusted_documents(labels: DataFrame) -> DataFrame:
    """Documents that the labels call good."""
    return labels_of(labels, "quality").filter("label = 1").select("doc_id")
