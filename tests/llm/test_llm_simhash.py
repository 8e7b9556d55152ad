import os
import sys

import numpy as np
from xxhash import xxh64_intdigest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from data import ROWS, documents, with_clashes  # noqa: E402

from kestrel.llm import simhash  # noqa: E402
from kestrel.llm.graph import components, local_forest  # noqa: E402
from kestrel.llm.queries import op10_simhash  # noqa: E402


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ")
             .replace("\r", " ").split(" ") if w]
    runs = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids, radius):
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    x = np.array(fps, np.uint64)
    for i in range(len(x)):
        for j in np.nonzero(np.bitwise_count(x[i] ^ x) <= radius)[0].tolist():
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
    best = {}
    for i in range(len(x)):
        k = (ids[i] is None, ids[i] or 0)
        best[top(i)] = min(best.get(top(i), k), k)
    return [None if best[top(i)][0] else best[top(i)][1] for i in range(len(x))]


def check(got, rows, radius=2):
    fps = [plain(t) for _, t in rows]
    want = brute_components(fps, [i for i, _ in rows], radius)
    assert sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in got) == sorted(
        (repr(i), f"{f:016x}", repr(c)) for (i, _), f, c in zip(rows, fps, want))


def test_whole_table(spark, sf_small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    check(op10_simhash(spark, sf_small).collect(), rows)


def test_edge_rows_and_blocks(spark):
    rows = [(r[0], r[1]) for r in ROWS]
    check(simhash.near_duplicates(with_clashes(documents(spark)), block=2).collect(), rows)
    check(simhash.near_duplicates(documents(spark), radius=20, block=2).collect(), rows, 20)


def test_no_link_is_lost_in_crowded_tiles(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    fps = np.concatenate([base ^ (np.int64(1) << rng.integers(0, 63, 40)) for _ in range(12)] + [base])
    fps = np.unique(fps)
    df = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    got = components(simhash.links(df, 2, block=3)).collect()
    roots = {int(f): int(f) for f in fps} | {r.node: r.root for r in got}
    want = brute_components(fps.view(np.uint64).tolist(), fps.astype(object).tolist(), 2)
    group = {}
    for f, c in zip(fps.tolist(), want):
        group.setdefault(c, set()).add(roots[f])
    assert all(len(x) == 1 for x in group.values()) and len(set(roots.values())) == len(group)


def test_keep_one(spark):
    rows = [*ROWS, (20, ROWS[0][1], "en", "a", 1)]
    kept = simhash.keep_one(with_clashes(documents(spark, rows))).collect()
    names = [repr(r.doc_id) for r in kept]
    assert names.count("1") == 1 and "2" not in names and "20" not in names
    assert names.count("7") == 2 and names.count("None") == 2  # the long text once, the other text of that id too
    assert names.count("4") == 1 and "5" not in names and "6" not in names  # no words: one group
    assert kept[0].t == "clash"


def test_local_forest_and_chain(spark):
    a, b = local_forest(np.arange(1, 200), np.arange(0, 199))
    assert set(b.tolist()) == {0} and len(a) == 199
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100
    assert components(links.where("a < 0")).collect() == []


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).collect() == []
    assert simhash.keep_one(documents(spark, [])).collect() == []
