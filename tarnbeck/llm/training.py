"""Bounded samples of labelled documents, which is all that classifiers learn from here.

A sample takes the rows of each label whose hashed doc_id falls below a threshold set from the label's
count, so about `per_label` of each, at any input size. Only ids reach the driver or a broadcast; the
texts stay on the executors, where features are taken from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels that a model may learn; what is broadcast holds per_label rows of each.
MOST_LABELS = 256
_SPAN = 1 << 31


def remainder(doc_id: str, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def sample_labels(labels: DataFrame, label: str, per_label: int) -> DataFrame:
    """doc_id and label of about per_label rows of each value; null labels and ids are left out.

    Raises if there are more than MOST_LABELS values, as the result is meant to be broadcast.
    """
    labels = labels.select("doc_id", F.col(label).alias("label")).filter("doc_id is not null and label is not null")
    counts = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    below = F.lit(0)
    for value, n in counts.items():
        below = F.when(F.col("label") == F.lit(value), F.lit(_SPAN if n <= per_label else int(_SPAN * per_label / n))).otherwise(below)
    return labels.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(_SPAN)) < below)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int) -> DataFrame:
    """doc_id, text and label of the sample. The broadcast side has about per_label rows of each label."""
    picked = sample_labels(labels, label, per_label)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
