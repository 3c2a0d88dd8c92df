"""The registered queries of this folder and their reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Key of the registered queries; a real one comes from the caller.
KEY = "example key"
QUERIES = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op7_exact_dedup", sql="""
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                  'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)""")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


@query("op10_compression_quality")
def compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .compress_quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op1_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    from .byte_bpe import encode_and_decode

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_and_decode(docs, path, public_tokenizers.PATTERN).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op2_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op6_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .suffix_dedup import cut_repeats

    return cut_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_ngram_join")
def ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import Rule, linked_documents

    return linked_documents(table(spark, sf_dir, "documents"), Rule(words=3, num=90, den=100))


@query("op5_bit_code_neighbours")
def bit_code_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .bit_codes import search

    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


@query("op3_hidden_markov_scores")
def hidden_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hidden_markov import language_scores

    return language_scores(table(spark, sf_dir, "documents"))


@query("op4_pseudonyms")
def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .pseudonyms import KINDS, pseudonymised

    out = pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)
    return out.select("doc_id", *[F.coalesce(F.col("pseudonyms")[k], F.lit(0).cast("bigint")).alias(f"n_{k}") for k in KINDS],
                      "text")


@query("op9_secret_spans")
def secret_spans_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .secret_spans import secret_spans, shown

    out = secret_spans(table(spark, sf_dir, "documents"))
    count = (lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint"))
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                      F.sha2(shown(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
                      shown(F.col("spans")).alias("spans"))


@query("op13_pair_merges")
def pair_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    from .pair_merges import encode

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded="decoded").select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op12_hard_negatives", sql="""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, CAST(floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x
      FROM r),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, any_value(a.label) AS own, any_value(b.label) AS label, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM e a JOIN e b ON a.i = b.i AND a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id GROUP BY 1, 2),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE label <> own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10""")
def hard_negative_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .strassen_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


#: Unsigned CRC-32 of a decimal text, bit by bit.
CRC32 = """xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, len(c) + 1), lambda i: ascii(c[i])::BIGINT),
    lambda crc, b: list_reduce([xor(crc, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
                               lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


@query("op11_prefix_trie", sql=f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS c, list({{'r': role, 't': text}} ORDER BY p) AS own FROM t GROUP BY 1),
h AS (SELECT *, CAST({CRC32} % 6 AS BIGINT) AS h FROM l),
r AS (SELECT a.conv_id, coalesce(b.own, [])[1:a.h] || a.own[a.h + 1:] AS s
      FROM h a LEFT JOIN l b ON b.conv_id = a.conv_id - a.conv_id % 100),
w AS (SELECT conv_id, len(s) AS n, unnest(range(0, len(s) + 1)) AS depth, s AS whole FROM r),
n AS MATERIALIZED (
  SELECT depth, whole[1:depth] AS s, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) > depth AS inner_node,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM w GROUP BY 1, 2),
up AS (SELECT depth, conv_id, inner_node, CASE WHEN depth > 0 THEN (n_convs - 1) * length(s[depth].t) ELSE 0 END AS saved,
              unnest(range(0, depth + 1)) AS d, s AS whole FROM n),
sub AS (SELECT d, whole[1:d] AS s, count(*) FILTER (depth = d + 1) AS n_children, count(*) FILTER (NOT inner_node) AS n_leaves,
               CAST(sum(saved) AS BIGINT) AS saved_tokens FROM up GROUP BY 1, 2)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN sub ON sub.d = n.depth AND sub.s = n.s
  LEFT JOIN n p ON p.depth = n.depth - 1 AND p.s = n.s[1:n.depth - 1]""")
def prefix_trie_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations")).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
