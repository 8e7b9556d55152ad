"""Quality rules: how much likelier a text's n-grams are in trusted texts than in
the raw corpus, beside a few counts.

Byte n-grams of every text are hashed into ``BUCKETS`` buckets. The raw
multinomial counts them over all documents, the target one over the documents
labelled good; the target's shares are mixed with ``PRIOR`` of the raw shares, so that
ratios hang on shares alone and a table repeated any number of times gets the same
verdicts. A text's
ratio is the mean over its n-grams of log(target share / raw share), so texts of
any length are compared alike, and every text is kept or not by one threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, cut, slices, text_of
from .textstats import COUNTS, counts

NGRAM = 4
BUCKETS = 1 << 16
#: Part of the smoothed target's shares that are the raw ones.
PRIOR = 0.2
#: Texts with a mean log ratio below this are not kept.
THRESHOLD = -0.25
LEAST_WORDS, MOST_REPEATED = 20, 30
BASE = COUNTS[:5]


def ngram_buckets(text: str, n: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all runs of ``n`` bytes; a shorter text has none."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) < n:
        return np.empty(0, np.int64)
    m = len(raw) - n + 1
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = h * np.uint64(257) + raw[k:k + m]
    h = (h + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64)


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(bucket, raw, target) over all rows of ``docs`` (t, good): a row for each
    bucket, so a bounded table; each task counts before anything is shuffled."""
    def run(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in slices(batches, 256):
            mine = {False: [], True: []}
            for x, good in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = ngram_buckets(x)
                mine[bool(good)].append(h)
            for good, parts in mine.items():
                n = np.bincount(np.concatenate(parts or [np.empty(0, np.int64)]), minlength=BUCKETS)
                raw += n
                if good:
                    target += n
        at = np.nonzero(raw)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])],
                                         ["bucket", "raw", "target"])

    return (docs.mapInArrow(run, "bucket int, raw bigint, target bigint").groupBy("bucket")
            .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))


def log_ratios(raw: np.ndarray, target: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Per bucket log(smoothed target share / raw share), log(``prior``) at least; 0
    where neither has been seen, and everywhere without a target."""
    n_raw, n_target = raw.sum(), target.sum()
    seen = raw > 0
    out = np.zeros(len(raw))
    if n_target > 0:
        out[seen] = np.log((1 - prior) * (target[seen] / n_target) / (raw[seen] / n_raw) + prior)
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log ratios of all buckets; trusted are the documents with a label of 1."""
    good = cut(labels.where(F.col(label) == 1).where(F.col(id_col).isNotNull())
               .select(F.col(id_col).alias("lid"), F.lit(True).alias("good")).distinct())
    src = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    both = src.join(checked_broadcast(good, good.count()), F.col("id") == F.col("lid"), "left")
    rows = corpus_counts(both.select("t", F.coalesce("good", F.lit(False)).alias("good"))).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, r, t in rows:
        raw[b], target[b] = r, t
    return log_ratios(raw, target)


def judge(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    llr, kept) for every row.

    base_failed: fewer than 20 words, or more than 30 % of them in eight-word
    windows found twice or more. kept: not base_failed and a mean log ratio of
    ``threshold`` or more. NULL and empty texts have no words and fail.
    """
    src = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches):
        for b in slices(batches, 512):
            texts = b.column(1).to_pylist()
            base = np.array([counts(x)[:5] for x in texts], np.int64).reshape(-1, 5)
            llr = []
            for x in texts:
                h = ngram_buckets(x)
                llr.append(float(ratio[h].mean()) if len(h) else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, base.T), pa.array(llr, pa.float64())],
                                             ["id", *BASE, "llr"])

    out = src.mapInArrow(run, f"id {kind}, {', '.join(f'{c} bigint' for c in BASE)}, llr double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return (out.withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
            .withColumnRenamed("id", id_col))
