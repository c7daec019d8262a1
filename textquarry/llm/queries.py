"""Registered queries of the pipeline's operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import (
    decontam,
    fingerprints,
    linedup,
    lmscore,
    minhash,
    negatives,
    packing,
    quality,
    sql,
    surrogates,
    tokenfiles,
    variants,
    viterbi,
    warc,
)
from textquarry.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query("op2_circulant_minhash", sql.NEAR_DUPLICATES)
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents at similarity 0.8 on four-word shingles."""
    found = minhash.near_duplicates(table(spark, folder, "documents"), width=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op3_reversible_line_dedup", sql.LINE_DEDUP)
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of 40 characters in five documents, left in one of them."""
    cleaned = linedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return cleaned.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256")
    )


@query("op5_token_files")
def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as byte-pair ids in flat files, read back from them."""
    path = scratch_path(spark, "tokens")
    tokenfiles.write_tokens(table(spark, folder, "documents"), path)
    back = tokenfiles.read_tokens(spark, path)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op6_histogram_best_fit")
def best_fit(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 4,096 tokens; ids stay in the written pieces."""
    cut = packing.pieces(table(spark, folder, "documents"))
    digests = cut.select(
        "row", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")
    )
    return digests.join(packing.place(cut), "row").drop("row")


@query("op7_tokeniser_fertility")
def fertility(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and tokenizer fertility of every document, and the verdict."""
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rated = quality.rate(table(spark, folder, "documents"))
    return rated.select(
        *first, "base_failed", "kept", "script", "n_tokens", "n_byte_tokens", "letters",
        "n_letter_tokens", "token_entropy",
    )


@query("op9_greedy_string_tiling")
def contamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that cover half of a benchmark item's words, in any order of its pieces."""
    return decontam.contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


@query("op4_count_only_viterbi")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Unigram token counts of every document."""
    return viterbi.count_tokens(table(spark, folder, "documents"))


@query("op8_warc", sql.WARC)
def warc_pages(spark: SparkSession, folder: str) -> DataFrame:
    """All pages as WARC records, written and read back.

    Digests and sizes of responses are worked out from their payloads, those of
    revisits are in their headers.
    """
    path = scratch_path(spark, "warc")
    warc.write_pages(table(spark, folder, "pages"), path)
    page = lambda c: F.expr(f"cast(nullif(substring({c}, 10), 'none') as bigint)")
    full = warc.read_warc(spark, path).where("record_type = 'response'")
    seen = warc.read_warc(
        spark, path, "record_id string, record_type string, refers_to string, payload_digest string, payload_bytes long"
    ).where("record_type = 'revisit'")
    responses = full.select(
        page("record_id").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )
    revisits = seen.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page("refers_to").alias("refers_to"),
    )
    return responses.union(revisits)


@query("op10_masked_pseudo_likelihood")
def pseudo_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    """Masked pseudo-likelihood of every document under a network trained on all of them."""
    return lmscore.score(table(spark, folder, "documents"))


@query("op1_keyed_surrogates")
def keyed_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with keyed surrogates in the place of personal data."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return surrogates.pseudonymize(docs)


@query("op11_sorted_list_variants", sql.VARIANTS)
def spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Words of six letters in five places, the words one edit away, their forms and roots."""
    docs = table(spark, folder, "documents")
    return variants.spelling_variants(docs, drop_modulus=variants.DROP_MODULUS)


@query("op12_packed_hard_negatives", sql.HARD_NEGATIVES)
def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of the rows whose id 100 divides; one row in seven has a moved label."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = negatives.integer_vectors(table(spark, folder, "embeddings").withColumn("label", moved))
    return negatives.hard_negatives(vectors, vectors.where("vec_id % 100 = 0"))


@query("op13_one_permutation_fingerprints")
def document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and their likeness."""
    found = fingerprints.fingerprints(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), "fingerprint",
        "edited_fingerprint", "near_edited", "near_next",
    )
