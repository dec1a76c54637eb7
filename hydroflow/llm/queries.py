"""One registered query per operator, over its whole table, and its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroflow.llm import (backoff_lm, decontamination, kd_sharding, ngram_join, order_minhash, packing, prefix_trie, quality_llr,
                           quality_qda, ranked_search, toxicity, warc_archive, wavelet)
from hydroflow.llm.common import fold_is, scratch_path, table

#: Scores from here on count as label 1.
LEAST_SCORE = 0.7

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Texts that go to a Python worker at a time.
BATCH_TEXTS = "256"


def query(name: str, sql: str | None = None):
    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_TEXTS)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return register


@query("op1_warc_archive", """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f""")
def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    warc_archive.write_archive(table(spark, sf_dir, "pages"), folder)
    return warc_archive.page_digests(spark, folder)


@query("op2_kd_sharding")
def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = kd_sharding.kd_shards(table(spark, sf_dir, "documents"), 40)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                         "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op3_wavelet_tokens")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_table(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op4_quality_discriminant")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_qda.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold_is("doc_id", 4, 2))
    return scored.withColumn("predicted", (F.col("score") >= LEAST_SCORE).cast("int"))


@query("op5_packing")
def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op6_ngram_join", """
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
rows AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM rows a JOIN rows b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
          WHERE 100 * n_both >= 80 * (len(x.s) + len(y.s) - n_both)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  WITH RECURSIVE r(v, u) AS (SELECT a, b FROM edges UNION SELECT r.v, e.b FROM r JOIN edges e ON r.u = e.a)
  SELECT v, min(u) AS least FROM r GROUP BY v)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(reach.least, doc_id)) AS component_id
FROM sets LEFT JOIN reach ON v = doc_id""")
def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(table(spark, sf_dir, "documents"))


@query("op7_quality_likelihood")
def likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = quality_llr.trusted_documents(table(spark, sf_dir, "labels"))
    return quality_llr.likelihood(table(spark, sf_dir, "documents"), trusted).drop("ratio")


@query("op8_decontamination")
def decontaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_backoff_scores")
def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.score(table(spark, sf_dir, "documents"), fold_is("doc_id", 5, 1))


@query("op10_toxicity")
def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold_is("doc_id", 3, 1))
    return scored.withColumn("predicted", (F.col("score") >= LEAST_SCORE).cast("int"))


@query("op11_ranked_search", """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
a AS (SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM d),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, a GROUP BY term, big_n),
i AS (SELECT DISTINCT item_id, text FROM benchmark),
q AS (SELECT item_id, text, term, count(*) AS n FROM (
        SELECT item_id, text, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i) GROUP BY ALL),
m AS (SELECT r, doc_id, 25 + (75 * len(w) * big_n) // big_l AS m FROM d, a),
s AS (SELECT item_id, text, r, doc_id, CAST(sum(n * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN t USING (term) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM k WHERE rank <= 10""")
def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


@query("op12_order_minhash")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_fingerprints(table(spark, sf_dir, "documents"), from_files=True)


@query("op13_prefix_trie", """
WITH t AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''),
         sha256(concat(octet_length(encode(coalesce(role, ''))), ':', coalesce(role, ''), coalesce(text, '')))) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)),
        lambda v, b: list_reduce(list_prepend(xor(v, b), [1::UBIGINT, 1, 1, 1, 1, 1, 1, 1]),
                                 lambda x, o: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)), 4294967295::UBIGINT) % 9 AS n FROM t),
b AS (SELECT h.conv_id, list_concat(coalesce(g.s, [])[1:h.n], h.s[h.n + 1:]) AS s FROM h LEFT JOIN t g ON g.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, unnest(range(0, len(s) + 1)) AS d, s FROM b),
g AS (SELECT s[1:d] AS pre, d, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(s) = d), '')) AS ends_sha256 FROM p GROUP BY ALL),
e AS (SELECT g.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM g c WHERE c.d = g.d + 1 AND c.pre[1:g.d] = g.pre) AS n_children,
             CASE WHEN g.d = 0 THEN 0 ELSE (g.n_convs - 1) * octet_length(encode(g.pre[g.d].t)) END AS saved
      FROM g LEFT JOIN g u ON u.d = g.d - 1 AND u.pre = g.pre[1:g.d - 1])
SELECT e.conv_id, CAST(e.d AS BIGINT) AS depth, e.parent_conv_id, e.n_convs, e.n_children, CAST(sum((x.n_children = 0)::INT) AS BIGINT) AS n_leaves,
       CAST(sum(x.saved) AS BIGINT) AS saved_tokens, e.ends_sha256
FROM e JOIN e x ON x.d >= e.d AND x.pre[1:e.d] = e.pre
GROUP BY e.pre, e.conv_id, e.d, e.parent_conv_id, e.n_convs, e.n_children, e.ends_sha256""")
def trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))
