"""Labelled rows for fitting, and the held-out fold of the contracts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows a classifier is fitted on at most: those with the smallest hashed ids.
FIT_ROWS = 20_000
FOLDS = 5


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def held_out(doc_id: Column) -> Column:
    """Fold 0; a null doc_id belongs to no fold and is not held out."""
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def fit_rows(labels: DataFrame, label: str, most: int = FIT_ROWS) -> DataFrame:
    """(doc_id, label, fold) of at most ``most`` labelled rows outside fold 0.
    Nulls and ids that are labelled both ways take no part."""
    one = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
           .groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other"))
           .where("label = other").select("doc_id", F.col("label").cast("int").alias("label"), fold(F.col("doc_id")).alias("fold")))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row (doc_id, label, fold, text) for each fit row found in docs, so at
    most FIT_ROWS; of an id that repeats, the text with the smallest hash."""
    found = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    return found.groupBy("doc_id", "label", "fold").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def scored(batches, score):
    """mapInArrow body: appends score and predicted to doc_id and held_out."""
    for b in batches:
        s = score(b)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64())],
                                         names=["doc_id", "held_out", "score"])


SCORED = "doc_id long, held_out boolean, score double"
