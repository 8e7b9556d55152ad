"""Helpers shared by the text operators: lineage cuts in the shared folder,
partition counts from the input's size, checked broadcasts and word splitting.

Conventions of every operator in this subpackage, unless its docstring says
otherwise:

* it reads only the columns it is told to (an id and a text, say), so further
  columns of the input, whatever their names, do not touch the result;
* a NULL text counts as the empty text; a NULL id is kept as NULL;
* repeated rows give one output row each;
* an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: A table is broadcast only when it was counted and has no more rows than this.
BROADCAST_ROWS = 500_000


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder (``spark.checkpoint.dir``); it is deleted
    when the driver's JVM ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kestrel-{uuid.uuid4().hex}"
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write_cut(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder and read it back: a lineage
    cut that survives lost executors. Returns the table and its path."""
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    return write_cut(df)[0]


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def checked_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` stay within the bound,
    else as it is (Spark then shuffles; the result is the same)."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def text_of(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fold(col: str, k: int) -> Column:
    """Remainder of crc32 of the id as text; NULL ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % k


def ascii_words(text: str, lower: bool = False) -> list[bytes]:
    """Words between ASCII white space (0x09-0x0D and the space), as UTF-8 bytes;
    ``lower`` lower-cases A-Z and nothing else."""
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def shingle_hashes(words: list[bytes], k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``k`` words joined by single spaces, repeats included;
    fewer words: of the whole sequence; none: an empty array."""
    from xxhash import xxh64_intdigest
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if n <= k:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - k])).tolist()
    stops = (ends[k - 1:] - 1).tolist()
    return np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, stops)], np.uint64)


def slices(batches, rows: int, most_bytes: int = 16 << 20):
    """Arrow batches cut into pieces of at most ``rows`` rows and ``most_bytes`` bytes
    (or one row), so that what Python holds beside a batch stays small however long
    the texts are."""
    for b in batches:
        todo = [b.slice(i, rows) for i in range(0, b.num_rows, rows)][::-1]
        while todo:
            x = todo.pop()
            if x.num_rows > 1 and x.nbytes > most_bytes:
                half = x.num_rows // 2
                todo += [x.slice(half), x.slice(0, half)]
            else:
                yield x


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """``keys``, and the whole row as the struct ``row``: whatever the columns of
    ``docs`` are called, they can't clash with what is joined to it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       *[c.alias(k) for k, c in keys.items()])


def unpacked(df: DataFrame, columns: list[str], *more: str, **new: Column) -> DataFrame:
    """The columns of ``row``, with ``new`` in their places, and ``more``."""
    return df.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in columns], *more)
