"""Periodic runs in word sequences, by an enhanced suffix array.

A run is a stretch of consecutive words in which words ``q`` apart are identical,
``q`` being its smallest period, and which no neighbouring word extends. It is found
through its last square: a square ww is *branching* if the word after it differs
from the word at the start of its second half, and every run of period q ends with
exactly one branching square of half length q.

The suffix array, its inverse (ISA) and the LCP array of a slice of documents are
built as flat arrays. For each LCP interval of depth d all children but the largest
hand in their suffixes: a square of half length d starts at i where ISA[i + d] lies in
the same interval, and at i - d where ISA[i - d] does. Branching squares are rotated to
the left as long as the words stay equal, and squares of one end whose half is a
multiple of a shorter run's period merge into that run. No tree is built: intervals
are pairs of positions, found by nearest smaller values of the LCP array.

Documents never share an interval, since a word counts as another word in each
document and each document ends in a word of its own. So the work of a slice is
O(n log n) in its words, and its memory a few dozen bytes a word, however its
words repeat. Texts are rows of a map; nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of

#: A run has so many words at least, and so many times its period.
LEAST_WORDS = 6
LEAST_PERIODS = 4
WORD = r"[^\x20\x09-\x0D]+"
#: Steps of all suffixes or squares together before the rest goes on one by one.
TOGETHER = 32
#: Suffixes tested at once.
PIECE = 1 << 20


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(SA, ISA) by prefix doubling that sorts only suffixes not yet told apart.
    The last token of every part that repeats must be unique (documents end in one)."""
    sa = np.argsort(tokens, kind="stable")
    n = len(sa)
    first = np.empty(n, bool)
    first[:1] = True
    np.not_equal(tokens[sa[1:]], tokens[sa[:-1]], out=first[1:])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    k = 1
    while True:
        last = np.append(first[1:], True)
        slot = np.flatnonzero(~(first & last))  # in groups of two and more
        if not len(slot):
            return sa, rank
        i = sa[slot]
        key = rank[i] * (n + 1) + rank[i + k]
        order = np.argsort(key, kind="stable")
        key, i = key[order], i[order]
        sa[slot] = i
        new = np.empty(len(slot), bool)
        new[:1] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        first[slot] = new
        rank[i] = slot[np.maximum.accumulate(np.where(new, np.arange(len(slot)), 0))]
        k *= 2


def _alike(tokens: np.ndarray, a: int, b: int, step: int) -> int:
    """How many tokens agree from ``a`` and ``b`` on, forwards or (step -1) backwards."""
    done, width = 0, 2 * TOGETHER
    while True:
        room = len(tokens) - max(a, b) if step > 0 else min(a, b) + 1
        width = min(width, room)
        if width <= 0:
            return done
        x = tokens[a:a + width] if step > 0 else tokens[a - width + 1:a + 1][::-1]
        y = tokens[b:b + width] if step > 0 else tokens[b - width + 1:b + 1][::-1]
        other = x != y
        at = int(other.argmax())
        if other[at]:
            return done + at
        done, a, b, width = done + width, a + step * width, b + step * width, 2 * width


def agreeing(tokens: np.ndarray, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """``_alike`` of every pair: some steps of all pairs at once, then one by one."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for k in range(TOGETHER):
        x, y = a[live] + step * k, b[live] + step * k
        ok = (np.minimum(x, y) >= 0) & (np.maximum(x, y) < len(tokens))
        ok[ok] = tokens[x[ok]] == tokens[y[ok]]
        live = live[ok]
        out[live] += 1
        if not len(live):
            return out
    for j in live.tolist():
        out[j] += _alike(tokens, int(a[j]) + step * TOGETHER, int(b[j]) + step * TOGETHER, step)
    return out


def lcp_array(tokens: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """lcp[r]: tokens that the suffixes at r - 1 and r share; lcp[0] = lcp[n] = -1.
    Compared only where the words before two neighbours differ (their lengths sum up
    to O(n log n)); every other value is one less than that of the position before."""
    n = len(sa)
    lcp = np.full(n + 1, -1, np.int64)
    if n < 2:
        return lcp
    a, b = sa[:-1], sa[1:]
    own = (a == 0) | (b == 0) | (tokens[a - 1] != tokens[b - 1])
    plus = np.zeros(n, np.int64)  # lcp by text position, plus the position
    known = np.zeros(n, bool)
    known[sa[0]] = True
    plus[sa[0]] = sa[0]
    known[b[own]] = True
    plus[b[own]] = b[own] + agreeing(tokens, a[own], b[own], 1)
    source = np.maximum.accumulate(np.where(known, np.arange(n), 0))
    lcp[1:n] = plus[source[b]] - b
    return lcp


def _nearest(lcp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place of ``at`` the nearest place to the left with a value not above
    its own: pointers jump over pointers, and what is left after some rounds is
    followed in order, when all pointers to the left are final."""
    left = np.arange(-1, len(lcp) - 1)
    live = at
    for _ in range(TOGETHER):
        live = live[lcp[left[live]] > lcp[live]]
        if not len(live):
            return left
        left[live] = left[left[live]]
    low, ptr = lcp.tolist(), left.tolist()
    for r in live.tolist():
        p, v = ptr[r], low[r]
        while low[p] > v:
            p = ptr[p]
        ptr[r] = p
    return np.array(ptr, np.int64)


def _ends(ptr: np.ndarray) -> np.ndarray:
    """Where each chain of pointers ends (ends point at themselves)."""
    while True:
        nxt = ptr[ptr]
        if np.array_equal(nxt, ptr):
            return ptr
        ptr = nxt


def branching_squares(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, half length) of every branching square."""
    sa, isa = suffix_array(tokens)
    lcp = lcp_array(tokens, sa)
    at = np.flatnonzero(lcp > 0)
    none = np.empty(0, np.int64)
    if not len(at):
        return none, none
    before = _nearest(lcp, at)
    after = len(lcp) - 1 - _nearest(lcp[::-1], len(lcp) - 1 - at[::-1])[::-1]
    every = np.arange(len(lcp))
    same = np.zeros(len(lcp), bool)
    same[at] = lcp[before[at]] == lcp[at]
    head = _ends(np.where(same, before, every))  # an interval's first boundary names it
    same[:] = False
    same[at] = lcp[after[at]] == lcp[at]
    tail = _ends(np.where(same, after, every))
    # children: what lies left of each boundary, and what lies right of the last one
    heads = at[head[at] == at]
    lo = np.concatenate((before[at], tail[heads]))
    hi = np.concatenate((at, after[tail[heads]]))
    of = np.concatenate((head[at], heads))
    size = hi - lo
    most = np.zeros(len(lcp), np.int64)
    np.maximum.at(most, of, size)
    largest = np.zeros(len(lcp), np.int64)
    big = np.flatnonzero(size == most[of])
    largest[of[big]] = big
    small = np.flatnonzero(largest[of] != np.arange(len(of)))
    lo, size, of = lo[small], size[small], of[small]
    found = []
    ends = np.cumsum(size)
    cut = 0
    while cut < len(size):  # pieces of whole children
        stop = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + PIECE, "right")))
        part = slice(cut, stop)
        n = size[part]
        place = np.arange(int(n.sum())) + np.repeat(lo[part] - (np.cumsum(n) - n), n)
        whose = np.repeat(of[part], n)
        i, d = sa[place], lcp[whose]
        low, high = before[whose], after[tail[whose]]  # the interval, first and after the last
        for start, partner in ((i, i + d), (i - d, i - d)):
            ok = np.flatnonzero(start >= 0)
            r = isa[partner[ok]]
            ok = ok[(r >= low[ok]) & (r < high[ok])]
            x, w = start[ok], d[ok]
            apart = tokens[x + w] != tokens[x + 2 * w]
            found.append(np.stack((x[apart], w[apart])))
        cut = stop
    both = np.unique(np.concatenate(found, axis=1), axis=1)
    return both[0], both[1]


def runs_of(tokens: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (start, length, period) of the runs with length >= max(least, periods * period),
    by start, then period. ``periods`` is two or more."""
    x, d = branching_squares(tokens)
    end = x + 2 * d
    order = np.lexsort((d, end))
    d, end = d[order], end[order]
    out = []
    while len(d):
        first = np.append(True, end[1:] != end[:-1])
        q, e = d[first], end[first]
        start = e - 2 * q - agreeing(tokens, e - 2 * q - 1, e - q - 1, -1)
        out.append(np.stack((start, e - start, q)))
        group = np.cumsum(first) - 1
        # a square of the same end inside the run: its half is a multiple of the period
        merged = (end - 2 * d >= start[group]) & (d % q[group] == 0)
        d, end = d[~merged], end[~merged]
    if not out:
        return np.empty((0, 3), np.int64)
    runs = np.concatenate(out, axis=1).T
    runs = runs[runs[:, 1] >= np.maximum(least, periods * runs[:, 2])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def tokens_of(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' words as one array of numbers, each text closed by a number of its
    own, in which equal words of different texts differ; and the texts' first places."""
    known: dict[bytes, int] = {}
    flat = [known.setdefault(w, len(known) + 1) for words in texts for w in words]
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(n + 1) - (n + 1)
    of = np.repeat(np.arange(len(texts)), n + 1)
    word = np.zeros(int((n + 1).sum()), np.int64)
    inside = np.ones(len(word), bool)
    inside[starts + n] = False
    word[inside] = flat
    return of * (len(known) + 1) + word, starts


def find(texts: list[list[bytes]], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS):
    """For each text its runs, rows (start, length, period), and the mask of words kept."""
    if not texts:
        return []
    tokens, starts = tokens_of(texts)
    runs = runs_of(tokens, least, periods)
    of = np.searchsorted(starts, runs[:, 0], "right") - 1
    cover = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(cover)[:-1] == 0
    runs[:, 0] -= starts[of]
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    return [(runs[bounds[i]:bounds[i + 1]], keep[s:s + len(t)])
            for i, (s, t) in enumerate(zip(starts.tolist(), texts))]


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS,
         periods: int = LEAST_PERIODS) -> DataFrame:
    """(id, n_words, runs array<struct<start, length, period>>, collapsed) of every row:
    the runs of at least ``least`` words and ``periods`` periods, by start and period,
    and the text without the words that a run contains after its first period, the
    words kept joined by one space.

    Words are what lies between ASCII white space. NULL and empty texts and texts of
    fewer than ``least`` words have no runs; repeated rows give one result each; rows
    that tie in everything are kept. A text of any length is looked at whole. Other
    columns are not read.
    """
    src = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    id_type = src.schema["id"].dataType.simpleString()
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for b in slices(batches, 2048, 2 << 20):
            texts = [t.split() for t in b.column(1).cast(pa.binary()).to_pylist()]
            got = find(texts, least, periods)
            found = [r for r, _ in got]
            table = np.concatenate(found) if found else np.empty((0, 3), np.int64)
            ends = np.cumsum([0, *map(len, found)])
            rows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(table[:, k]) for k in range(3)], fields=list(kind)))
            clean = [b" ".join(w if k.all() else [w[j] for j in np.flatnonzero(k).tolist()])
                     for w, (_, k) in zip(texts, got)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(list(map(len, texts)), pa.int64()), rows,
                 pa.array(clean, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])

    out = src.mapInArrow(run, f"id {id_type}, n_words bigint, "
                              "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def with_loops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): the texts, those of ids whose crc32 is divisible by ten with a part
    that repeats. Of n words, numbered from 0, word i >= a becomes word a + (i - a) % p,
    a = g % n, p = 1 + (n - a) div (3 + g % 8), g = crc32 div 10. Texts without words
    and rows without an id stay as they are."""
    part = (docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
            .withColumn("h", F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(1))))
    loops = F.col("h") % 10 == 0
    g = F.floor(F.col("h") / 10)
    n = F.size("words")
    part = part.withColumn("words", F.when(loops, F.regexp_extract_all("t", F.lit(WORD), F.lit(0))))
    part = part.withColumn("a", F.when(n > 0, (g % n)).cast("int"))
    part = part.withColumn("p", F.expr("cast(1 + (size(words) - a) div (3 + floor(h / 10) % 8) as int)"))
    body = F.expr("slice(words, a + 1, p)")
    times = F.expr("cast((size(words) - a - 1) div p + 1 as int)")
    again = F.slice(F.flatten(F.array_repeat(body, times)), F.lit(1), n - F.col("a"))
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), again), " ")
    return part.select(F.col("id").alias(id_col),
                       F.when(loops & (n > 0), planted).otherwise(F.col("t")).alias(text_col))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``runs``' rows as numbers and digests: n_runs; start, length, period and
    exponent_milli of the run with the greatest length to period (ties: smallest
    start, then period; all NULL without a run); runs_sha256 of every run's
    ``start,length,period`` and a line feed; collapsed_sha256."""
    # runs come by start and period, so the first of equal exponents stays
    best: Column = F.reduce("runs", F.expr("cast(null as struct<start:bigint,length:bigint,period:bigint>)"),
                            lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r)
                            .otherwise(a))
    rows = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return (found.withColumn("best", best)
            .select(id_col, F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
                    F.col("best.length").alias("length"), F.col("best.period").alias("period"),
                    F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
                    F.sha2(rows.cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))
