import os
import re
import sys
from collections import defaultdict

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from data import ROWS, documents, rows_of, with_clashes  # noqa: E402

from kestrel.llm import mixing  # noqa: E402
from kestrel.llm.queries import ORACLE, op5_mixing  # noqa: E402


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, share=1.5, weights=(3, 1, 2), passes=2):
    """Shares dealt out again until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total >= passes * sizes[s]]
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = float(passes * sizes[s])
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


def check(got, rows, near):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += n_words(text)
    want = targets(sizes)
    by = {}
    for i, text, source in rows:
        by.setdefault(repr(i), []).append((n_words(text), source))
    taken, seen = defaultdict(int), defaultdict(int)
    for r in got:
        seen[repr(r.doc_id)] += 1
        source = next(s for n, s in by[repr(r.doc_id)] if n == r["size"] and sizes[s] == r.source_size)
        assert r.target == pytest.approx(want[source], rel=1e-9)
        assert 0 <= r.taken <= 2 * r["size"]
        taken[source] += r.taken
    assert seen == {k: len(v) for k, v in by.items()}
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(near * t, mixing.BLOCK), (s, taken[s], t)


def test_whole_table(spark, sf_small):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    check(op5_mixing(spark, sf_small).collect(), rows, 0.03)


def test_equals_sql(spark, sf_oracle):
    from oracle_check import compare, duck
    ok, why = compare(op5_mixing(spark, sf_oracle).toPandas(), duck(sf_oracle).execute(ORACLE["op5_mixing"]).df())
    assert ok, why


def test_edge_rows(spark):
    check(mixing.mix(with_clashes(documents(spark)).drop("size")).collect(), [(r[0], r[1], r[3]) for r in ROWS], 0.05)


def test_reruns_and_partitions_agree(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text", "source")
    assert rows_of(mixing.mix(docs)) == rows_of(mixing.mix(docs.repartition(7, "text").orderBy("text")))


def test_native(spark, sf_small):
    plan = op5_mixing(spark, sf_small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_shards_are_full_and_blocks_in_turn(spark):
    docs = spark.createDataFrame([(i, "s%d" % (i % 3), 200 + i) for i in range(300)], "id long, source string, size long")
    src = mixing.source_table(docs).cache()
    slots = src.groupBy().sum("slots").first()[0]
    rows = mixing.fill(src, slots, shard=64).collect()
    assert len(rows) == slots
    by = defaultdict(list)
    for r in rows:
        by[r.sid].append((r.q, r.block))
    for s in src.collect():
        got = sorted(by[s.sid])
        assert [q for q, _ in got] == list(range(s.slots))
        for e in range(0, s.slots, s.blocks):  # every block once before any comes again
            some = [b for _, b in got[e:e + s.blocks]]
            assert len(set(some)) == len(some) and all(0 <= b < s.blocks for b in some)


def test_documents_of_the_mix(spark):
    rows = [r for r in ROWS if r[0] != 7]
    docs = with_clashes(documents(spark, rows))
    plan = {repr(r.doc_id): r for r in mixing.mix(documents(spark, [r for r in rows if r[0] is not None])).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = defaultdict(int)
    texts = {(r[0], r[1] or ""): (r[1] or "") for r in rows}
    for r in out.collect():
        words[repr(r.doc_id)] += n_words(r.text)
        source = re.findall(r"[^\x20\x09-\x0D]+", next(t for k, t in texts.items() if k[0] == r.doc_id and n_words(t) >= n_words(r.text)))
        assert set(re.findall(r"[^\x20\x09-\x0D]+", r.text)) <= set(source) or r.doc_id is None
        assert r["size"] == "clash"
    assert {"4", "5", "6"} <= set(words)  # texts without words stay
    # the same mix: NULL ids only shift which documents of their source are taken
    assert all(words[k] <= 2 * p["size"] for k, p in plan.items())


def test_empty_table(spark):
    assert mixing.mix(documents(spark, [])).collect() == []
    assert mixing.mixed_documents(documents(spark, [])).collect() == []
    assert mixing.mix(documents(spark, [(1, None, None, None, None), (2, " ", None, "a", 1)])).count() == 2
