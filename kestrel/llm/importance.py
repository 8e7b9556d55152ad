"""Target-distribution importance resampling over hashed word n-grams.

A document's features are its words and its pairs of neighbouring words, joined by a
space; each is counted in the bucket crc32 mod ``BUCKETS``. The buckets' shares in a
target table against those in all documents give each bucket a gain, a document's weight
is the mean gain of its features, and the documents with the highest weights plus Gumbel
noise from a hash of their ids are drawn, which is sampling without replacement in
proportion to the weights' exponentials.

Features are never built as strings. Each task keeps an Aho-Corasick automaton of
distinct words, each between its two delimiters, whose payload leads to the word's CRC,
the CRC of the word and a space, and its length. A scan over a slice of texts emits
payloads in text order; as neighbours share their delimiter, what lies between two
matches that don't is words the automaton lacks, which get payloads of their own, so
nothing is missed. A pair's CRC is composed from two payloads: the first word's is moved
on by the second one's length (a linear map, by tables of powers of two) and XORed with
the second one's. The automaton holds the distinct words of the task's first slice of
texts, so its size is bounded by a slice; it speeds the scan and changes no result.

Bucket counts are summed in each task first; what comes to the driver and goes back is
``BUCKETS`` numbers, however large the tables are.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import global_row_number
from .common import cut, slices, text_of

BUCKETS = 10_000
#: Of the documents with LEAST_WORDS words or more, so many per cent are drawn.
PERCENT = 25
LEAST_WORDS = 20
SEED = 7
#: Texts of a slice hold about so many bytes, or are one text.
SLICE_BYTES = 4 << 20
#: Words kept beside the automaton from slice to slice, at most.
SPARE = 1 << 18

#: Everything but digits, letters and what is beyond ASCII parts words.
_PARTS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def feature_words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased."""
    return text.lower().translate(_PARTS).split()


def _shift_tables(powers: int = 32) -> np.ndarray:
    """[k, j, v]: what byte j of a CRC, with value v, becomes when 2**k zero bytes follow."""
    byte = np.arange(256, dtype=np.uint64)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ 0xEDB88320, byte >> 1)
    bits = np.uint64(1) << np.arange(32, dtype=np.uint64)
    image = (bits >> 8) ^ byte[bits & 255]  # of each bit, when one zero byte follows
    tables = np.zeros((powers, 4, 256), np.uint64)
    for k in range(powers):
        for j in range(4):
            for b in range(8):
                tables[k, j] ^= np.where(np.arange(256) >> b & 1, image[8 * j + b], 0).astype(np.uint64)
        image = _through(tables[k], image)
    return tables


def _through(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0, crc & 255] ^ table[1, crc >> 8 & 255] ^ table[2, crc >> 16 & 255] ^ table[3, crc >> 24]


_SHIFT = _shift_tables()


def composed(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two byte strings on end, from their CRCs and the second one's length."""
    out = first.copy()
    k = 0
    while True:
        left = length >> k
        if not left.any():
            return out ^ second
        odd = np.flatnonzero(left & 1)
        out[odd] = _through(_SHIFT[k], out[odd])
        k += 1


class Payloads:
    """Words' payloads by number, found by an automaton's scan."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.automaton = None
        self.held = 0
        self.crc = self.spaced = self.length = np.empty(0, np.uint64)

    def _add(self, words: list[str]) -> None:
        """Numbers and payloads of words not met before, latin-1 views of their bytes."""
        new = [w for w in dict.fromkeys(words) if w not in self.numbers]
        if not new:
            return
        for w in new:
            self.numbers[w] = len(self.numbers)
        raw = [w.encode("latin-1") for w in new]
        crc = [zlib.crc32(w) for w in raw]
        self.crc = np.append(self.crc, np.array(crc, np.uint64))
        self.spaced = np.append(self.spaced, np.array([zlib.crc32(b" ", c) for c in crc], np.uint64))
        self.length = np.append(self.length, np.array(list(map(len, raw)), np.uint64))

    def _trim(self) -> None:
        if len(self.numbers) - self.held > SPARE:
            self.numbers = dict(list(self.numbers.items())[: self.held])
            self.crc, self.spaced, self.length = (x[: self.held] for x in (self.crc, self.spaced, self.length))

    def scan(self, text: str) -> np.ndarray:
        """Numbers of the words of ``text``: words parted, begun and ended by one space."""
        if self.automaton is None:
            from ahocorasick import STORE_INTS, Automaton
            words = text.split(" ")[1:-1]
            if not words:
                return np.empty(0, np.int64)
            self._add(words)
            self.automaton = Automaton(STORE_INTS)
            for w, i in self.numbers.items():
                self.automaton.add_word(f" {w} ", i)
            self.automaton.make_automaton()
            self.held = len(self.numbers)
        self._trim()
        hits = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        ends, found = hits[:, 0], hits[:, 1]
        # the space that each match, and then the text's end, should begin at
        begins = np.append(ends - self.length[found].astype(np.int64) - 1, len(text) - 1)
        before = np.append(0, ends)
        gaps = np.flatnonzero(begins > before)
        if not len(gaps):
            return found
        between = [text[a + 1:b].split(" ") for a, b in zip(before[gaps].tolist(), begins[gaps].tolist())]
        self._add(list(chain.from_iterable(between)))
        more = [self.numbers[w] for w in chain.from_iterable(between)]
        return np.insert(found, np.repeat(gaps, list(map(len, between))), more)

    def features(self, texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words of each text, buckets of all words, buckets of all pairs, the texts that
        the pairs are of)."""
        words = [b" ".join(feature_words(t)) for t in texts]
        n = np.array([w.count(b" ") + 1 if w else 0 for w in words], np.int64)
        body = b" ".join(w for w in words if w)
        at = self.scan(f" {body.decode('latin-1')} " if body else " ")
        of = np.repeat(np.arange(len(texts)), n)
        same = np.flatnonzero(of[1:] == of[:-1])
        a, b = at[same], at[same + 1]
        pairs = composed(self.spaced[a], self.crc[b], self.length[b].astype(np.int64))
        return n, (self.crc[at] % buckets).astype(np.int64), (pairs % buckets).astype(np.int64), of[same]


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts lie in each bucket that has any."""
    def run(batches):
        held, total = Payloads(), np.zeros(buckets, np.int64)
        for b in slices(batches, 1 << 16, SLICE_BYTES):
            _, one, two, _ = held.features(b.column(0).cast(pa.binary()).to_pylist(), buckets)
            total += np.bincount(one, minlength=buckets) + np.bincount(two, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    return (docs.select(text_of(text_col).alias("t")).mapInArrow(run, "bucket int, n bigint")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text",
          buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain: the floor of a thousand times the log ratio of its share of the
    target's features to its share of all features, each count plus one."""
    spark = docs.sparkSession
    s, t = bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets)
    both = (spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
            .join(s.withColumnRenamed("n", "s"), "bucket", "left")
            .join(t.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0))
    both = cut(both)
    all_s, all_t = both.agg(F.sum("s").cast("double"), F.sum("t").cast("double")).first()
    ratio = ((F.col("t") + 1.0) * (F.lit(all_s) + buckets)) / ((F.col("s") + 1.0) * (F.lit(all_t) + buckets))
    rows = both.select("bucket", F.floor(F.log(ratio) * 1000).cast("long").alias("gain")).collect()
    out = np.zeros(buckets, np.int64)
    out[[r["bucket"] for r in rows]] = [r["gain"] for r in rows]
    return out


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of every row: the floored mean gain of its
    features, 0 without any."""
    src = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    id_type = src.schema["id"].dataType.simpleString()
    buckets = len(gain)

    def run(batches):
        held = Payloads()
        for b in slices(batches, 1 << 16, SLICE_BYTES):
            n, one, two, of = held.features(b.column(1).cast(pa.binary()).to_pylist(), buckets)
            total = np.zeros(len(n), np.int64)
            np.add.at(total, np.repeat(np.arange(len(n)), n), gain[one])
            np.add.at(total, of, gain[two])
            features = n + np.maximum(n - 1, 0)
            weight = total // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n), pa.array(features), pa.array(weight)],
                ["id", "n_words", "n_features", "weight"])

    return src.mapInArrow(run, f"id {id_type}, n_words bigint, n_features bigint, weight bigint")


def draw(weighted: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``weighted`` (id, n_words, weight and more) with score and rank. score: the weight
    plus Gumbel noise in thousandths, from the first 32 bits of sha256 of ``seed:id``.
    rank: 1, 2, 3... by falling score among the ``percent`` per cent (rounded down) with the
    highest scores of the rows with ``least_words`` words or more; else NULL. Ties go to
    the smaller id, NULL (as an empty text in the hash) last; rows that agree in all
    columns take their ranks in any order."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / 4294967296.0))).cast("long")
    # written down: the texts are scanned once, not again for the sort's sample
    scored = cut(weighted.withColumn("score", F.col("weight") + noise)
                 .withColumn("in", F.col("n_words") >= least_words))
    most = scored.where("in").count() * percent // 100
    order = [F.col("in").desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features"),
             F.col("n_words")]
    return (global_row_number(scored, order, "rn")
            .withColumn("rank", F.when(F.col("in") & (F.col("rn") <= most), F.col("rn"))).drop("rn", "in"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text", buckets: int = BUCKETS, **params) -> DataFrame:
    """(id, n_features, weight, score, rank, n_words) of every row of ``docs``, drawn to be
    like ``target``.

    Words are ASCII letters and digits and all that lies beyond ASCII, A-Z lower-cased;
    NULL and empty texts have none and weight 0. Without a target all gains come from
    the documents alone. Repeated rows are documents of their own. Other columns are
    not read.
    """
    out = draw(weights(docs, gains(docs, target, text_col, target_col, buckets), id_col, text_col), **params)
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank", "n_words")


def _crc_list() -> str:
    """The CRC-32 of each byte's step as a SQL list, from its rule."""
    table = range(256)
    for _ in range(8):
        table = [(c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1 for c in table]
    return "[" + ", ".join(f"{c}::BIGINT" for c in table) + "]"


#: ``resample`` with its default parameters in DuckDB SQL.
SQL = rf"""
WITH text AS MATERIALIZED (
  SELECT t, id, row_number() OVER () AS row,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM (SELECT 0 AS t, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark)),
feature AS (
  SELECT t, row, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS f
  FROM text),
bytes AS (
  SELECT f, list_transform(range(1, len(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT)) AS b, crc
  FROM (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM feature)), (SELECT {_crc_list()} AS crc)),
bucket AS (
  SELECT f, xor(list_reduce(b, lambda c, x: xor(c >> 8, crc[xor(c & 255, x) + 1]), 4294967295::BIGINT),
                4294967295::BIGINT) % {BUCKETS} AS k FROM bytes),
hit AS (SELECT t, row, k FROM feature JOIN bucket USING (f)),
per AS (SELECT k, count(*) FILTER (t = 0) AS s, count(*) FILTER (t = 1) AS t FROM hit GROUP BY k),
gain AS (
  SELECT k, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (sum(s) OVER () + {BUCKETS}::DOUBLE)
                                 / ((s + 1.0::DOUBLE) * (sum(t) OVER () + {BUCKETS}::DOUBLE)))) AS BIGINT) AS g FROM per),
mean AS (SELECT row, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight
         FROM hit JOIN gain USING (k) WHERE t = 0 GROUP BY row),
scored AS (
  SELECT id AS doc_id, len(words) AS n_words, greatest(0, 2 * len(words) - 1) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((
           CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE)
           / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM text LEFT JOIN mean USING (row) WHERE t = 0),
ranked AS (
  SELECT *, n_words >= {LEAST_WORDS} AS ok, count(*) FILTER (n_words >= {LEAST_WORDS}) OVER () * {PERCENT} // 100 AS most,
         row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS rn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN ok AND rn <= most THEN rn END AS rank, n_words FROM ranked
"""
