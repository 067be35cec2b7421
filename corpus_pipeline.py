"""From documents to token counts: toxicity, near duplicates, repeated passages, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of
documents; texts may be shorter after the third and rows repeat, once for each epoch,
after the fourth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm import byte_bpe, mixing, simhash, suffix_dedup, toxicity
from chatloom.llm.common import numbered_columns, written

#: All tokens of the input are the budget: what the weights take from a leaf they give to others.
SHARE = 1.0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a toxicity of at least toxicity.THRESHOLD; without any labels all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    if labels.where("toxic is not null").isEmpty():
        return docs
    model = toxicity.train(docs, labels)
    # Inner names, so that columns of the input that are called like the score stay what they are.
    inner, names = numbered_columns(docs)
    kept = toxicity.score(inner, model, text=names["text"], evidence=0).where(F.col("toxic_score") < toxicity.THRESHOLD)
    return kept.select(*names.values()).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least doc_id of each group of texts whose five-word shingles are alike to 0.8 or more."""
    return simhash.drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words and more that stand at an earlier place too."""
    return suffix_dedup.drop_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's share of the budget, some documents more than once and some not."""
    inner, names = numbered_columns(docs)
    mixed = mixing.mix(inner, share=SHARE, text=names["text"], key=names["doc_id"], lang=names["lang"], source=names["source"])
    return mixed.select(*names.values()).toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids_sha256 and decoded_sha256 of each row."""
    return byte_bpe.encode_documents(docs, *byte_bpe.public_vocabulary()).select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("repeated_passages", cut_repeats),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Toxicity, SimHash (XXH64) and encoding have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result but the last is written to the shared folder and read again, and removed when the next is written."""
    docs, drop = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        before = drop
        docs, drop = written(stage(spark, docs, sf_dir))
        if before:
            before()
    return STAGES[-1][1](spark, docs, sf_dir)
