"""Importance resampling: composed CRCs, the automaton's scan, the query against brute
force and DuckDB."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from data import documents, rows_of, with_clashes  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

from kestrel.llm import importance as I  # noqa: E402
from kestrel.llm.queries import ORACLE, op12_importance  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_buckets(text, buckets):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    return w, [zlib.crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def brute(rows, target, buckets=10_000, percent=25, least=20, seed=7):
    held = [(i, *brute_buckets(t, buckets)) for i, t in rows]
    s = Counter(k for _, _, f in held for k in f)
    t = Counter(k for x in target for k in brute_buckets(x, buckets)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (all_s + buckets) / ((s[k] + 1) * (all_t + buckets))))
            for k in range(buckets)]
    out = []
    for i, w, f in held:
        weight = sum(gain[k] for k in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))),
                    None, len(w)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[:len(able) * percent // 100]):
        r[4] = k + 1
    return sorted(tuple(map(repr, r)) for r in out)


def test_composed_crc():
    rng = random.Random(2)
    a = [rng.randbytes(rng.randint(0, 40)) for _ in range(500)]
    b = [rng.randbytes(rng.choice([0, 1, 2, 7, 64, 1000, 70_001])) for _ in range(500)]
    crc = [np.array([zlib.crc32(x) for x in xs], np.uint64) for xs in (a, b)]
    got = I.composed(*crc, np.array(list(map(len, b)), np.int64))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]


@pytest.mark.parametrize("spare", [0, 3, 1 << 18])
def test_scan_finds_words_that_the_automaton_lacks(monkeypatch, spare):
    monkeypatch.setattr(I, "SPARE", spare)
    rng = random.Random(4)
    held = I.Payloads()
    for k in range(60):
        texts = ["".join(rng.choice(["a", "B", "ab", "é", "漢", " ", "-", " ", "\n", "z" * rng.randint(1, 90), str(k)])
                         for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 5))]
        texts.append("")
        n, one, two, of = held.features([t.encode() for t in texts], 997)
        want = [brute_buckets(t, 997) for t in texts]
        assert n.tolist() == [len(w) for w, _ in want]
        assert one.tolist() == [f for w, x in want for f in x[:len(w)]]
        assert two.tolist() == [f for w, x in want for f in x[len(w):]]
        assert of.tolist() == [i for i, (w, x) in enumerate(want) for _ in x[len(w):]]
        assert len(held.numbers) <= held.held + spare + 400


def test_a_first_slice_without_words():
    held = I.Payloads()
    assert held.features([b"", b" - "], 10)[0].tolist() == [0, 0]
    assert held.features([b"a b a"], 1 << 40)[2].tolist() == [zlib.crc32(b"a b"), zlib.crc32(b"b a")]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_duckdb(spark, sf):
    ok, msg = compare(op12_importance(spark, sf).toPandas(), duck(sf).execute(ORACLE["op12_importance"]).df())
    assert ok, msg


def test_query_equals_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    bench = spark.read.parquet(f"{sf_small}/benchmark.parquet")
    assert rows_of(op12_importance(spark, sf_small)) == brute(
        [(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in bench.collect()])


def test_edge_rows(spark):
    docs = documents(spark)
    target = spark.createDataFrame([("row of words and more", 1), (None, 2), ("", 3)], "text string, item_id long")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()], least=5)
    assert rows_of(I.resample(with_clashes(docs), target, least_words=5)) == want
    assert sum(r[4] != "None" for r in want) == 3
    none = spark.createDataFrame([], "text string")
    assert rows_of(I.resample(docs, none, percent=100)) == brute(
        [(r["doc_id"], r["text"]) for r in docs.collect()], [], percent=100)
    empty = I.resample(documents(spark, []), target)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_features", "weight", "score", "rank", "n_words"]


def test_ranks_over_many_partitions_and_ties(spark):
    rows = spark.range(0, 5000, 1, 13).select(
        (F.col("id") % 2500).alias("id"), F.lit(30).cast("long").alias("n_words"), F.lit(59).cast("long").alias("n_features"),
        F.lit(-5).cast("long").alias("weight"))
    out = I.draw(rows, percent=50).where("rank is not null").orderBy("rank").collect()
    assert [r["rank"] for r in out] == list(range(1, 2501))
    assert out == sorted(out, key=lambda r: (-r["score"], r["id"], r["rank"]))
