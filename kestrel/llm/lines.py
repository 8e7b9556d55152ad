"""Line dedup over overlapping three-line windows.

Every run of ``WINDOW`` consecutive lines that hold a word is hashed (blank lines
are passed over), and a window found more than once over all documents keeps its
first occurrence, by document id and then position. The later occurrences'
positions are merged, and the lines they cover are removed.

An occurrence that overlaps the first one in the same document does not count as
a later one, so a line repeated four times in a row loses nothing but a longer
run is cut to its first window. As every removed line has an earlier equal line,
the first of a line's occurrences always stays.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, packed, slices, text_of, unpacked

WINDOW = 3
_WORD = re.compile(r"[^\x20\x09-\x0D]")


def text_windows(text: str, window: int = WINDOW) -> tuple[list[int], list[list[int]], list[bytes]]:
    """(ordinal, line numbers, digest) of each window of a text."""
    from xxhash import xxh3_128_digest
    lines = text.split("\n")
    at = [i for i, x in enumerate(lines) if _WORD.search(x)]
    n = max(0, len(at) - window + 1)
    held = [at[i:i + window] for i in range(n)]
    return list(range(n)), held, [xxh3_128_digest("\n".join([lines[j] for j in h])) for h in held]


def windows(docs: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """(id, text_hash, pos, held, h1, h2) for every window; ``held`` are its lines'
    numbers in the text."""
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("text_hash"),
                      text_of(text_col).alias("t"))
    id_type = src.schema["id"].dataType.simpleString()

    def run(batches):
        for b in slices(batches, 512):
            row, pos, held, digest = [], [], [], []
            for i, x in enumerate(b.column(2).to_pylist()):
                p, h, d = text_windows(x, window)
                row += [i] * len(p)
                pos += p
                held += h
                digest += d
            h = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(pos, pa.int32()),
                 pa.array(held, pa.list_(pa.int32())), pa.array(h[:, 0]), pa.array(h[:, 1])],
                ["id", "text_hash", "pos", "held", "h1", "h2"])

    return src.mapInArrow(run, f"id {id_type}, text_hash bigint, pos int, held array<int>, h1 bigint, h2 bigint")


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, text_hash, gone): the numbers of the lines that later occurrences cover,
    for documents that have any."""
    w = cut(windows(docs, id_col, text_col, window))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash", "pos")
    # written down, so that the join below deals out both sides anew and Spark can
    # split a window that very many documents share
    first = cut(w.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
                .where("n > 1").drop("n"))
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.text_hash"))
    later = w.join(first, ["h1", "h2"]).where(~same | (F.col("pos") >= F.col("first.pos") + window))
    return (later.select("id", "text_hash", F.explode("held").alias("line"))
            .groupBy("id", "text_hash").agg(F.collect_set("line").alias("gone")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the covered lines taken out of the text, and two columns more:
    n_lines (lines with a word) and n_removed.

    NULL text counts as empty; texts of fewer than ``window`` lines with a word
    have no window and stay as they are. NULL ids come last in the order; rows with
    one id and different texts are told apart by the text's hash; repeated rows are
    one document, whose copies get the same result.
    """
    gone = covered(docs, id_col, text_col, window)
    src = packed(docs, doc=F.col(id_col), body=text_of(text_col), hash=F.xxhash64(text_of(text_col)))
    out = src.join(gone, F.col("doc").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("text_hash")), "left")
    split = F.split("body", "\n", -1)
    left = F.array_join(F.filter(split, lambda x, i: ~F.array_contains("gone", i)), "\n")
    out = out.select(
        "row", F.when(F.col("gone").isNull(), F.col("body")).otherwise(left).alias("clean"),
        F.size(F.filter(split, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
    return unpacked(out, docs.columns, "n_lines", "n_removed", **{text_col: F.col("clean")})


#: The same in DuckDB SQL, for ids that are not repeated.
SQL = r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no
  FROM documents),
word AS (
  SELECT doc_id, line, no, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS pos
  FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
win AS (
  SELECT doc_id, pos, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS body
  FROM word WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
mark AS (
  SELECT doc_id, pos, first_value(doc_id) OVER w AS first_doc, first_value(pos) OVER w AS first_pos
  FROM win WHERE body IS NOT NULL WINDOW w AS (PARTITION BY body ORDER BY doc_id, pos)),
gone AS (
  SELECT DISTINCT m.doc_id, w.no FROM mark m JOIN word w
    ON w.doc_id = m.doc_id AND w.pos BETWEEN m.pos AND m.pos + 2
  WHERE m.doc_id <> m.first_doc OR m.pos >= m.first_pos + 3)
SELECT l.doc_id, count(*) FILTER (regexp_matches(l.line, '[^\x20\x09-\x0D]')) AS n_lines, count(g.no) AS n_removed,
       coalesce(string_agg(l.line, chr(10) ORDER BY l.no) FILTER (g.no IS NULL), '') AS text
FROM line l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.no = l.no
GROUP BY l.doc_id
"""
