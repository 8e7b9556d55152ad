"""Periodic runs: the suffix array and its parts, runs against brute force, the query."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.llm import periodic as P
from kestrel.llm.queries import op11_periodic_runs

from data import LONG, documents, rows_of, with_clashes


def brute_runs(words, least=6, periods=4):
    """Every maximal stretch of each period, kept if no smaller period holds in it."""
    n, out = len(words), []
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, periods * q) and not any(
                    all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, least=6, periods=4):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words, least, periods)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = hashlib.sha256
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
            sha(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest())


def periodic_words(rng, letters):
    out = []
    for _ in range(rng.randint(0, 5)):
        unit = [rng.choice(letters) for _ in range(rng.randint(1, 6))]
        out += (unit * rng.randint(1, 9))[:rng.randint(1, 60)]
    return out


def test_arrays_equal_their_definitions():
    rng = random.Random(1)
    for _ in range(200):
        tokens, _ = P.tokens_of([periodic_words(rng, [b"a", b"b"]) for _ in range(3)])
        sa, isa = P.suffix_array(tokens)
        t = tokens.tolist()
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        assert isa[sa].tolist() == list(range(len(t)))
        lcp = P.lcp_array(tokens, sa)
        for r in range(1, len(t)):
            a, b, k = int(sa[r - 1]), int(sa[r]), 0
            while max(a, b) + k < len(t) and t[a + k] == t[b + k]:
                k += 1
            assert lcp[r] == k


@pytest.mark.parametrize("letters, least, periods", [(b"ab", 6, 4), (b"ab", 2, 2), (b"abc", 4, 3), (b"abcdefgh", 6, 4)])
@pytest.mark.parametrize("together", [1, 32])
def test_runs_equal_brute_force(monkeypatch, letters, least, periods, together):
    monkeypatch.setattr(P, "TOGETHER", together)
    monkeypatch.setattr(P, "PIECE", 3 if together == 1 else 1 << 20)
    rng = random.Random(7)
    letters = [bytes([c]) for c in letters]
    texts = [periodic_words(rng, letters) for _ in range(150)]
    texts += [[rng.choice(letters) for _ in range(rng.randint(0, 90))] for _ in range(100)]
    for words, (runs, keep) in zip(texts, P.find(texts, least, periods)):
        want = brute_runs(words, least, periods)
        assert [tuple(r) for r in runs.tolist()] == want
        gone = {k for s, length, q in want for k in range(s + q, s + length)}
        assert keep.tolist() == [k not in gone for k in range(len(words))]


def test_branching_squares_are_those_of_the_definition():
    rng = random.Random(3)
    for _ in range(150):
        tokens, _ = P.tokens_of([[rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 40))]])
        t = tokens.tolist()
        want = {(i, d) for d in range(1, len(t) // 2 + 1) for i in range(len(t) - 2 * d)
                if t[i:i + d] == t[i + d:i + 2 * d] and t[i + d] != t[i + 2 * d]}
        x, d = P.branching_squares(tokens)
        assert len(x) == len(want) and set(zip(x.tolist(), d.tolist())) == want


def test_long_repetitions_stay_near_linear():
    """One word 200 000 times, Fibonacci words and nested powers: many squares of one
    end, long chains of LCP values."""
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 50_000:
        a, b = b, b + a
    for words, want in (([b"x"] * 200_000, [(0, 200_000, 1)]), ([b"x", b"y"] * 60_000, [(0, 120_000, 2)]),
                        ((([b"x"] * 50 + [b"y"]) * 40 + [b"z"]) * 20, None), (b, [])):
        runs = P.find([words])[0][0]
        if want is not None:
            assert [tuple(r) for r in runs.tolist()] == want
        else:
            top = [tuple(r) for r in runs.tolist() if r[2] > 1]
            assert (0, 2041 * 20, 2041) in top and (0, 51 * 40, 51) in top and len(runs) == 20 * 40 + 20 + 1


def test_edge_rows(spark):
    docs = with_clashes(documents(spark))
    got = {(r["doc_id"], r["collapsed"]): r for r in P.runs(docs).collect()}
    assert P.runs(docs).count() == docs.count()
    assert got[9, "tie"]["runs"] == [(0, 36, 1)] and got[9, "tie"]["n_words"] == 36
    assert got[4, ""]["runs"] == [] and got[5, ""]["n_words"] == 0 and got[6, ""]["runs"] == []
    assert (7, " ".join(LONG.split())) in got
    assert P.digest(P.runs(documents(spark, []))).count() == 0
    assert P.runs(docs, least=37).where("size(runs) > 0").count() == 0


def test_query_equals_brute_force(spark, sf_oracle):
    docs = spark.read.parquet(f"{sf_oracle}/documents.parquet").select("doc_id", "text")
    want = [brute_row(r["doc_id"], r["text"]) for r in docs.where(F.length("text") < 12_000).collect()]
    got = op11_periodic_runs(spark, sf_oracle)
    assert got.count() == docs.count()
    ids = {w[0] for w in want}
    assert sorted(tuple(map(repr, w)) for w in want) == rows_of(got.where(F.col("doc_id").isin(*ids)))


def test_loops_and_digest_on_small_rows(spark):
    tens = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:20]
    rng = random.Random(5)
    rows = [(i, " \n".join(f"w{rng.randint(0, 9)}" for _ in range(rng.randint(0, 60)))) for i in [*tens, *range(1, 40)]]
    rows += [(None, "a b " * 9), (tens[0], None), (tens[1], ""), (tens[2], "one"), (3, "x y z " * 4), (3, "x y z " * 4),
             (3, "aaa " * 5 + "b"), (77, "ä ß ä " * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = P.digest(P.runs(P.with_loops(docs)))
    assert rows_of(got) == sorted(tuple(map(repr, brute_row(*r))) for r in rows)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                           "collapsed_sha256"]
