"""A corpus pipeline of five operators: toxicity, near copies, secrets, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents. Classifier and Poisson draws can't be
put in SQL as a whole, so ``ORACLE_SQL`` is None; ``tests/llm`` holds every stage against brute force.

Null texts count as empty throughout; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistra.llm import mixing, ngram_join, packing, secrets, toxicity
from gistra.llm.text import ensure_unique
from gistra.staging import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at the threshold or above go."""
    scored = toxicity.score_documents(docs, toxicity.model_for(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    name = ensure_unique(docs.columns, ["toxicity"])["toxicity"]
    return scored.filter(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on five-word shingles the one of smallest id stays."""
    return ngram_join.keep_one(docs, ngram_join.Terms(words=5, percent=80))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars, where there is one, follows the text."""
    safe = secrets.redact(docs)
    return safe.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else safe


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights; a document may appear several times, or not."""
    return mixing.mix(docs, extra=False)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of permitted lengths."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scans", redact_secrets),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
