"""From documents to tokens: quality, boilerplate lines, near duplicates, source mix, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examlens.llm import bpe_tree, pareto_mix, quality_fm, simhash_tiles, site_lines
from examlens.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates have five-word shingle sets of Jaccard similarity 0.8 or more, which is checked
#: for all pairs of a candidate group.
#: Candidates come from 256-bit fingerprints of the sets: at 0.8 they differ in 39 bits on average
#: (10 of the first 64), in the worst case of five shingles in 48 (12). The radii leave four
#: standard deviations and more above these; unrelated texts differ in 128 (32).
WORDS, LEAST_SIMILARITY, PARTS, FIRST_RADIUS, WHOLE_RADIUS = 5, 0.8, 4, 24, 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score 0.5 or more), in one pass over the texts.

    Labels come from the table ``labels``; ``n_chars`` is metadata. Missing texts are scored as empty
    ones, a missing count as zero; repeated rows go or stay together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = quality_fm.fit(docs.select("doc_id", "text", "n_chars"), labels, metadata=["n_chars"])
    return quality_fm.accepted(docs.select(*COLUMNS), machine, metadata=["n_chars"])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; ``n_chars`` counted anew.

    Missing texts stay missing and have no count; a missing source is a source; repeated rows stay.
    """
    cut = site_lines.without_boilerplate(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id.

    Texts are near duplicates if their five-word shingles have similarity 0.8 or more, or if a
    chain of such texts joins them.

    Of rows that repeat an id one stays, the least by content. Rows without an id cannot be told
    apart and stay.
    """
    slim = docs.select(*COLUMNS)
    grouped = simhash_tiles.near_duplicates(
        slim.where(F.col("doc_id").isNotNull()),
        words=WORDS,
        least=LEAST_SIMILARITY,
        radius=FIRST_RADIUS,
        parts=PARTS,
        whole_radius=WHOLE_RADIUS,
    )
    stays = grouped.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    rest = [c for c in COLUMNS if c != "doc_id"]
    kept = (
        slim.join(stays, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("row")).select("doc_id", "row.*")
    )
    return kept.select(*COLUMNS).unionByName(slim.where(F.col("doc_id").isNull()))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a document stands there as often as it is taken, up to twice.

    Documents are told apart by id and content; equal rows are taken together. Missing texts and
    texts without words have size 0; a missing source is a source, the last.
    """
    slim = docs.select(*COLUMNS)
    copies = (
        pareto_mix.mix(slim)
        .where(F.col("copies") > 0)
        .groupBy(F.col("doc_id").alias("_id"), F.col("content").alias("_content"))
        .agg(F.sum("copies").alias("_copies"))
    )
    found = slim.withColumn("_key", F.xxhash64("text")).join(
        copies, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_content"))
    )
    once_each = found.groupBy("doc_id", "_key").agg(
        F.min(F.struct(*[c for c in COLUMNS if c != "doc_id"])).alias("row"), F.max("_copies").alias("_copies")
    )
    return once_each.select("doc_id", "row.*", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every document of the mix, and the digest of what the ids decode to.

    A missing text is empty; documents taken twice stand twice.
    """
    ranks = bpe_tree.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe_tree.encode(docs, ranks, public_tokenizers.PATTERN, decoded=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

#: A classifier, hash fingerprints and byte-pair merges have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is a written table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
