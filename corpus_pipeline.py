"""The training-data pipeline over `documents`, one operator per stage.

1. toxicity: documents that the classifier chain calls toxic go.
2. line_dedup: lines found in three or more documents stay only in the largest document id; n_chars follows.
3. jaccard_join: of each class of near copies the document with the smallest id stays.
4. decontamination: documents that contain a benchmark window go.
5. packing: the rest is packed into sequences; one row per piece.

Every stage reads all that the one before it kept. All but the last return the columns of `documents`.
"""

import public_tokenizers
from pyspark.sql import functions as F

from reduxlab.llm import decontamination, jaccard_join, line_dedup, packing, toxicity
from reduxlab.session import stored


def not_toxic(spark, docs, sf_dir):
    chain = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return chain.classify(docs).filter(~F.col("is_toxic")).select(*docs.columns)


def without_repeated_lines(spark, docs, sf_dir):
    kept = line_dedup.dedup(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def one_per_class(spark, docs, sf_dir):
    return jaccard_join.keep_one(docs)


def without_benchmark(spark, docs, sf_dir):
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark, docs, sf_dir):
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", not_toxic),
    ("line_dedup", without_repeated_lines),
    ("jaccard_join", one_per_class),
    ("decontamination", without_benchmark),
    ("packing", packed),
]
#: Learnt decisions and a packing plan have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage, every stage written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
