"""A bounded sample of labelled documents with their texts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch

#: Labelled rows that a classifier is fitted on, at most: the documented bound of the samples here.
ROWS = 20_000


def fold(doc_id: str = "doc_id", folds: int = 5) -> F.Column:
    """crc32 of the id as text, modulo `folds`; null for null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, target: str, scratch: Scratch, *, rows: int = ROWS, held_out: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(label, text) of the labelled documents outside fold `held_out`, at most `rows` labels of
    them, the first by a hash of the id. The labels, bounded so, are broadcast; no text is
    shuffled but those of repeated ids. Rows without an id or a label teach nothing. Of rows that repeat an id, one
    teaches: of documents that with the least text hash, of labels the least."""
    given = labels.select(F.col(doc_id).alias("__tm_id"), F.col(target).alias("label")).where("__tm_id is not null and label is not null")
    given = given.where(fold("__tm_id") != held_out).groupBy("__tm_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("__tm_id"), "__tm_id").limit(rows)
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(given), F.col("doc_id") == F.col("__tm_id"))
    picked = scratch.save(picked.select("doc_id", F.col("label").cast("int").alias("label"), F.coalesce("text", F.lit("")).alias("text")))
    if picked.groupBy("doc_id").count().where("count > 1").limit(1).count():
        picked = scratch.save(picked.groupBy("doc_id").agg(F.min_by(F.struct("label", "text"), F.xxhash64("text")).alias("x")).select("x.label", "x.text"))
    return picked.select("label", "text")
