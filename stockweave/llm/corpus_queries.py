"""The numbered queries over whole tables, and their statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.llm import mixing, phrase_dedup, suffix_dedup
from stockweave.llm.common import query, table
from stockweave.llm.decontamination import contamination
from stockweave.llm.html_extract import extract
from stockweave.llm.multi_index import search
from stockweave.llm.ngram_join import near_duplicates
from stockweave.llm.packing import pack
from stockweave.llm.quality import score_quality
from stockweave.llm.sharding import shard_by_bytes
from stockweave.llm.token_alignment import aligned_documents
from stockweave.llm.whitening import whiten


@query("op1_phrase_dedup")
def op1_phrase_dedup(spark: SparkSession, sf: str) -> DataFrame:
    got = phrase_dedup.remove_repeats(table(spark, sf, "documents"))
    return got.select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )

from stockweave.llm.toxicity import score_toxicity

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP2_SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[p : p + least(len(w), 13) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p
        FROM d CROSS JOIN (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, p, dw.n FROM dw JOIN iw ON dw.n = iw.n AND dw.gram = iw.gram),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS k FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
             sha256(array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',')) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


@query("op2_decontamination", OP2_SQL)
def op2_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    got = contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return got.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        "contaminated",
    )


@query("op3_packing")
def op3_packing(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    got = pack(
        table(spark, sf, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
    )
    return got.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op9_sharding")
def op9_sharding(spark: SparkSession, sf: str) -> DataFrame:
    got = shard_by_bytes(table(spark, sf, "documents"), 24)
    return got.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    got = suffix_dedup.remove_repeats(
        table(spark, sf, "documents"), columns=("id", "n_bytes", "n_removed", "span_start", "kept")
    )
    return got.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        "n_removed",
        F.size("span_start").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op10_ngram_join")
def op10_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op6_html_extract")
def op6_html_extract(spark: SparkSession, sf: str) -> DataFrame:
    return extract(table(spark, sf, "pages"))


@query("op8_multi_index")
def op8_multi_index(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return search(vectors, vectors.filter("vec_id % 100 = 0"))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    got = score_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return got.select("doc_id", "held_out", "score", "predicted")


@query("op7_quality")
def op7_quality(spark: SparkSession, sf: str) -> DataFrame:
    return score_quality(table(spark, sf, "documents")).select("doc_id", "quality", "good")


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whiten(table(spark, sf, "embeddings"))


@query("op12_mixing", mixing.statement())
def op12_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.taken(table(spark, sf, "documents"))


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    first, second, ranks = map(
        public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")
    )
    return aligned_documents(table(spark, sf, "documents"), first, second, ranks)
