"""Labelled training rows for the operators that learn from the label table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, checked_broadcast, cut, fold, slices, text_of


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, y, t) of the labelled rows outside the held-out fold. Of exact copies (the
    same words in the same order, A-Z in lower case, and the same label) one row
    counts, so that they are no evidence of their own; texts that only share a
    phrase or a passage all count.

    Several labels of one id: the largest; NULL ids or labels: not used.
    """
    lab = (labels.select(F.col(id_col).alias("lid"), F.col(label).cast("int").alias("y"))
           .where("lid is not null and y is not null").where(fold("lid", folds) != held_out)
           .groupBy("lid").agg(F.max("y").alias("y")))
    lab = cut(lab)
    src = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t")).where("id is not null")
    both = src.join(checked_broadcast(lab, lab.count()), F.col("id") == F.col("lid")).select("id", "y", "t")
    kind = both.schema["id"].dataType.simpleString()

    def mark(batches):
        from xxhash import xxh3_128_digest
        for b in slices(batches, 512):
            sig = [xxh3_128_digest(b" ".join(ascii_words(x, lower=True))) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(sig, pa.binary())], ["id", "y", "t", "sig"])

    marked = cut(both.mapInArrow(mark, f"id {kind}, y int, t string, sig binary"))
    one = cut(marked.groupBy("sig", "y").agg(F.min("id").alias("id")))
    keep = checked_broadcast(one, one.count())
    return marked.join(keep, ["sig", "y", "id"], "left_semi").select("id", "y", "t")
