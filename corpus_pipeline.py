"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of ``documents``. A stage's table is deleted when the next one's is written,
that of the last but one when the driver ends.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veilscan.llm import common, decontaminate, ngram_join, quality_rules, source_mix, token_output


def quality(spark, docs, sf_dir):
    """Documents that the base rules or a risk-controlled cutoff reject go."""
    return quality_rules.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark, docs, sf_dir):
    """Of each group of documents linked by shingles one stays, the one of the smallest id."""
    return ngram_join.representatives(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark, docs, sf_dir):
    """A row for each pass in which a document is taken, with the words that are."""
    return source_mix.mixed_documents(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark, docs, sf_dir):
    """Records of token ids: written to files, and what the files hold."""
    return token_output.round_trip(docs, token_output.default_tokenizer())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

#: SQL has no tokenizer, and no tiling.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        folder = common.own_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before is not None:
            common.delete(before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
