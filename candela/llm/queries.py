"""Queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm import divergence, extraction, filter_audit, langid, media, minmax_dedup, mixing, packing, pii, quality, simhash, suffix_dedup, warc
from candela.llm.common import documents


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that strings of 100 bytes repeat, removed from every text; null texts are empty, rows without a doc_id stay whole."""
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """128-bit fingerprints of every text and its half-edited text, their likeness, and the neighbours within 6 bits of every fiftieth document."""
    return simhash.half_edits(documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learnt from three quarters of the labelled documents; null texts and texts without a letter are `und`."""
    held = langid.held_out()
    out = langid.identify(documents(spark, sf_dir), ~held)
    return out.select("doc_id", held.alias("held_out"), "language_id.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as often as a Poisson draw at the rate of its source gives, sources weighted by the root of their size; documents drawn zero times give no row."""
    return mixing.replicate(documents(spark, sf_dir)).select("doc_id", "source", "rate", "copies", "copy", "shuffle_key")


def op5_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose five-word shingles agree by 0.85 or more; documents without words are groups of their own."""
    return minmax_dedup.near_duplicates(documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document by the two views and by both; nulls and empty texts are scored like other values."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score(documents(spark, sf_dir), labels).select("doc_id", "quality.*")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every text: counts of each kind, a digest of the base kinds and all spans; null texts are empty."""
    found = documents(spark, sf_dir).select("doc_id", pii.find_pii(F.col("text")).alias("found"))

    def digest(kinds):
        mine = F.filter("found", lambda s: s["kind"].isin(*kinds))
        return F.concat_ws(",", F.transform(mine, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    added = [count(kind) for kind in pii.KINDS if kind not in pii.BASE]
    return found.select(
        "doc_id", *map(count, pii.BASE), F.sha2(digest(pii.BASE).cast("binary"), 256).alias("base_sha256"), digest(pii.KINDS).alias("spans"), *added,
        F.size("found").cast("long").alias("n_spans"),
    )


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a stored image, read back, with where its figure stands on the document's own page and on the page of its number."""
    return media.document_media(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; null and textless pages give empty text."""
    return extraction.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes in sequences of 1,024 tokens; null texts are their end token alone."""
    return packing.pack(documents(spark, sf_dir))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the content-addressed archive of all pages says of each once its records are read back; null pages are empty."""
    return warc.archived_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes at each step of each of their 120 orders, by language; null texts are empty."""
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of the sources of each language and their ten most distinctive terms; null text, lang and source are empty."""
    return divergence.audit_sources(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline`` over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_simhash, op3_language_id, op4_mixing, op5_minmax_dedup, op6_quality, op7_pii, op8_media,
    op9_extraction, op10_packing, op11_warc, op12_filter_audit, op13_source_divergence, pipeline)}
ORACLES = {"op4_mixing": mixing.ORACLE_SQL, "op11_warc": warc.ORACLE_SQL, "op12_filter_audit": filter_audit.ORACLE_SQL,
    "op13_source_divergence": divergence.ORACLE_SQL}
