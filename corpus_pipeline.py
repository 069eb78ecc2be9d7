"""A training corpus from `documents`: quality, toxicity, near duplicates, benchmark passages, mix."""

from pyspark.sql import functions as F

from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.jaccard import one_of_each
from tidemark.llm.mixing import mix
from tidemark.llm.quality import good
from tidemark.llm.store import Scratch
from tidemark.llm.toxicity import civil


#: Words of a benchmark passage that is cut from a document that stays: a window of the contract.
SPAN = 13


def quality(spark, docs, sf_dir):
    """Documents that resampling toward those labelled good rejects go."""
    return good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def toxicity(spark, docs, sf_dir):
    """Documents that score 0.5 or more go."""
    return civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near duplicates stays."""
    return one_of_each(docs)


def contamination(spark, docs, sf_dir):
    """Documents with benchmark passages in a twentieth of their words or more go; from the others,
    passages of SPAN words or more are cut, and n_chars follows."""
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), max_span=SPAN)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def mixture(spark, docs, sf_dir):
    """What each document gives to the mix; documents that give nothing go."""
    out = mix(docs, keep=["text", "lang", "n_chars"]).where(F.col("taken") > 0)
    names = {"__tm_k0": "text", "__tm_k1": "lang", "__tm_k2": "n_chars"}
    return out.withColumnsRenamed(names).select("doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "epochs", "taken")


STAGES = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("contamination", contamination),
    ("mixture", mixture),
]

#: SQL can't express the classifiers; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
        scratch.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
