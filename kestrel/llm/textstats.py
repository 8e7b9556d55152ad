"""Counts of a text that quality rules and classifiers use."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, slices, text_of

#: Words of a window that counts as repeated if it is in the text twice or more.
REPEAT = 8
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\v\f\r"
_HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_lines", "n_unique", "n_same", "n_bang", "n_stop", "n_upper", "n_digit")


def repeated_words(ids: np.ndarray, size: int = REPEAT) -> int:
    """Words that lie in windows of ``size`` words found twice or more, the first
    occurrence included. Windows are numbered by doubling, so equal numbers mean
    equal windows; a 64-bit hash tells first whether any could be equal."""
    n = len(ids) - size + 1
    if n < 2:
        return 0
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + mixed[k:k + n]
    order = np.sort(h)
    if not (order[1:] == order[:-1]).any():
        return 0
    width, number = 1, ids.astype(np.int64)
    while width < size:
        step = min(width, size - width)
        pair = number[: len(number) - step] * (int(number.max()) + 1) + number[step:]
        number = np.unique(pair, return_inverse=True)[1]
        width += step
    twice = np.nonzero(np.bincount(number)[number] > 1)[0]
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + size, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def counts(text: str) -> tuple[int, ...]:
    """``COUNTS`` of a text: words between ASCII white space, code points in them,
    symbols, lines equal to an earlier one, words in repeated windows, lines with a
    word, different words, words equal to the one before, exclamation marks, full
    stops and question marks, upper-case ASCII letters, digits."""
    words = ascii_words(text)
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    n = len(words)
    lines = [x for x in text.split("\n") if _HAS_WORD.search(x)]
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    of = np.bincount(raw, minlength=256)
    return (n, len(text) - sum(int(of[ord(c)]) for c in _SPACE), sum(int(of[ord(c)]) for c in SYMBOLS),
            len(lines) - len(set(lines)), repeated_words(ids) if len(number) < n else 0,
            len(lines), len(number), int((ids[1:] == ids[:-1]).sum()), int(of[33]), int(of[46] + of[63]),
            int(of[65:91].sum()), int(of[48:58].sum()))


def with_counts(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and ``COUNTS`` (long) of every row; a NULL text counts as empty."""
    src = docs.select(*keep, text_of(text_col).alias("__t"))
    kinds = ", ".join([*(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} bigint" for c in COUNTS)])

    def run(batches):
        for b in slices(batches, 512):
            got = np.array([counts(x) for x in b.column(len(keep)).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *map(pa.array, got.T)],
                                             [*keep, *COUNTS])

    return src.mapInArrow(run, kinds)


def ratios() -> dict:
    """Statistics as Spark columns over ``COUNTS``; texts without words divide by 1."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    chars = F.greatest("word_chars", F.lit(1))
    return {
        "words": F.col("n_words").cast("double"), "word_length": F.col("word_chars") / words,
        "symbols": F.col("n_symbols") / words, "bangs": F.col("n_bang") / words, "stops": F.col("n_stop") / words,
        "dup_lines": F.col("n_dup_lines") / lines, "repeats": F.col("n_repeat_words") / words,
        "same": F.col("n_same") / words, "unique": F.col("n_unique") / words, "upper": F.col("n_upper") / chars,
        "digits": F.col("n_digit") / chars, "line_words": F.col("n_words") / lines,
    }
