"""A bounded choice of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most about ``rows`` labelled documents: columns ``order``, ``text``, ``label``.

    The labels are chosen by a hash of ``doc_id``, a fixed choice whatever the partitions are, so
    only ``rows`` ids are broadcast and the documents are read once, without a shuffle. Null texts
    are empty; null ids and labels are left out; a repeated label counts once, differing labels
    of one document are one example each, and so are differing texts of one id.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(
        "doc_id is not null and label is not null"
    )
    count = known.count()
    order = F.xxhash64(F.col("doc_id"), F.lit("labelled"))
    # A first choice by hash leaves little for the exact one.
    share = min(1.0, 1.2 * rows / max(count, 1))
    draw = F.shiftrightunsigned(order, 11) / float(1 << 53)
    chosen = (
        known.select("*", order.alias("order"))
        .where(draw <= share)
        .distinct()
        .orderBy("order", "doc_id", "label")
        .limit(rows)
    )
    return (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .select("order", "text", "label")
        .distinct()
    )
