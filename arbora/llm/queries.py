"""The operators as queries over whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import decode, encode
from .common import fold, table, utf8
from .decontaminate import flag
from .filter_audit import audit
from .importance import score_documents
from .language_id import identify, train
from .lattice_lm import score_texts
from .near_dedup import near_duplicates
from .oracle import AUDIT_SQL, RESAMPLE_SQL
from .shuffle_shards import uniform_shards
from .topk import top_k
from .toxicity import score as score_toxicity
from .toxicity import train as train_toxicity
from .url_filter import Rule, host_of, judge, path_of, rule_of
from .url_filter import train as train_urls
from .vp_trees import nearest
from .warc import archive, base32_sha1, page_number, read_warc

SHARDS = 24
WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
NEIGHBOURS = 5
NEAREST = 10
RULES = [
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of ``benchmark`` items in ``documents``: a row per document and passage, none for clean documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    flagged = flag(docs, table(spark, sf_dir, "benchmark"))
    return flagged.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op2_boosted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every url of ``pages``; the trees learn from the urls that a rule decides."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    ruled = rule_of(host_of(F.col("url")), path_of(F.col("url")), RULES)["verdict"]
    model = train_urls(pages.select("url", (ruled == "block").cast("int").alias("blocked")).filter("blocked IS NOT NULL"))
    return judge(pages, RULES, model).drop("url")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` encoded and decoded; digests of ids and of the decoded text."""
    path = vocabulary(WORD_BPE)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = decode(encode(docs, path).drop("text"), path)
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learnt from the labelled texts outside fold 0 of 5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(fold("doc_id", 5) != 0)
    scored = score_toxicity(docs, train_toxicity(docs.join(labels, "doc_id")))
    return scored.select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


def op5_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every text, learnt from the texts outside fold 2 of 7."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, vocabulary(PIECES), fold("doc_id", 7) == 2, keep=["doc_id"])


def op6_weighted_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates of every row of ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")


def op7_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best inner products for each fiftieth row of ``embeddings``, against all rows."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, rows.filter(F.col("vec_id") % 50 == 0), NEIGHBOURS)


def op8_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in 24 shards by the law ``rows``; copies of a text are spread."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(utf8("text")) + 8).cast("bigint").alias("size"),
        F.crc32(utf8("text")).alias("text_crc32"),
    )
    placed = uniform_shards(docs, SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learnt from the labelled texts outside fold 2 of 4."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(fold("doc_id", 4) != 2))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id",
        (fold("doc_id", 4) == 2).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.col("lang_bits").alias("code_bits"),
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of ``pages``, read back: responses with their payloads, revisits by headers alone.

    Length and digest of a response are those of the payload that was read; a
    revisit has none and takes both from its headers.
    """
    path = archive(table(spark, sf_dir, "pages"))
    columns = lambda size, digest: [
        page_number("record_id").alias("page_id"),
        size.cast("bigint").alias("payload_bytes"),
        digest.alias("payload_digest"),
        "record_type",
        page_number("refers_to").alias("refers_to"),
    ]
    full = read_warc(spark, path).filter("record_type = 'response'")
    heads = read_warc(spark, path, payload=False).filter("record_type = 'revisit'")
    return full.select(*columns(F.octet_length("payload"), base32_sha1(F.col("payload")))).unionByName(
        heads.select(*columns(F.col("payload_bytes"), F.col("payload_digest")))
    )


def op11_vantage_point_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten rows found nearest to each hundredth row of ``embeddings``, among all rows."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.filter(F.col("vec_id") % 100 == 0), NEAREST)


def op12_segment_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of every row of ``documents`` towards the texts of ``benchmark``, and the five percent that are drawn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, table(spark, sf_dir, "benchmark").select("text"))
    return scored.select(F.col("key").alias("doc_id"), "n_features", "weight", "score", "rank")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the five filters keep and remove in each of their 120 orders, per language of ``documents``."""
    return audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_boosted_urls": op2_boosted_urls,
    "op3_transducer_bpe": op3_transducer_bpe,
    "op4_string_kernel_toxicity": op4_string_kernel_toxicity,
    "op5_lattice_lm": op5_lattice_lm,
    "op6_weighted_near_duplicates": op6_weighted_near_duplicates,
    "op7_bit_sliced_top_k": op7_bit_sliced_top_k,
    "op8_shuffle_shards": op8_shuffle_shards,
    "op9_ppm_language": op9_ppm_language,
    "op10_warc": op10_warc,
    "op11_vantage_point_neighbours": op11_vantage_point_neighbours,
    "op12_segment_resampling": op12_segment_resampling,
    "op13_filter_audit": op13_filter_audit,
}

TOP_K_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {NEIGHBOURS}
"""

# Base32 of a SHA-1: five hexadecimal digits are four letters.
_LETTERS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(CAST('0x' || substr(h, {1 + 5 * i}, 5) AS BIGINT) // {32 ** (3 - j)} % 32 AS BIGINT) + 1, 1)"
    for i in range(8)
    for j in range(4)
)
WARC_SQL = f"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes, {_LETTERS} AS payload_digest, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""

ORACLE_SQL: dict[str, str] = {
    "op7_bit_sliced_top_k": TOP_K_SQL,
    "op10_warc": WARC_SQL,
    "op12_segment_resampling": RESAMPLE_SQL,
    "op13_filter_audit": AUDIT_SQL,
}
