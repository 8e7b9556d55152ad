import math
import os
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from data import ROWS, documents, labels, with_clashes  # noqa: E402

from kestrel.llm import lm_scoring, quality_rules, rule_ensemble, textstats  # noqa: E402
from kestrel.llm.queries import op2_lm_scoring, op4_rule_ensemble, op6_quality_rules  # noqa: E402

SPACE = " \t\n\v\f\r"


def words(text):
    for c in SPACE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def base(text):
    w, seen, dup = words(text), [], 0
    for x in text.split("\n"):
        if words(x):
            dup += x in seen
            seen.append(x)
    runs = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    cover = {i + k for i in range(len(w) - 7) if runs[tuple(w[i:i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(cover)


@pytest.mark.parametrize("text", ["", " ", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 9, "x " * 30,
                                  "é|#\n\né|#\né|#", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 0 2 3 4 5 6 7 8 9", ROWS[8][1] or ""])
def test_counts(text):
    assert textstats.counts(text)[:5] == base(text)


def test_quality_rules_whole_table(spark, sf_small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{sf_small}/labels.parquet").collect() if r.quality == 1}
    grams = {i: Counter(quality_rules.ngram_buckets(t or "").tolist()) for i, t in docs.items()}
    raw = sum(grams.values(), Counter())
    target = sum((grams[i] for i in good), Counter())
    n_raw, n_target, prior = sum(raw.values()), sum(target.values()), quality_rules.PRIOR
    ratio = {b: math.log(((1 - prior) * target[b] / n_target + prior * raw[b] / n_raw) / (raw[b] / n_raw)) for b in raw}
    got = op6_quality_rules(spark, sf_small).collect()
    assert len(got) == len(docs)
    for r in got:
        b = base(docs[r.doc_id] or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 20 or 100 * b[4] > 30 * b[0])
        g = grams[r.doc_id]
        llr = sum(ratio[x] * k for x, k in g.items()) / max(1, sum(g.values()))
        assert r.llr == pytest.approx(llr, abs=1e-9)
        assert r.kept == (not r.base_failed and r.llr >= quality_rules.THRESHOLD)


def test_quality_verdicts_do_not_hang_on_the_number_of_rows(spark):
    rng = np.random.default_rng(0)
    raw = rng.integers(0, 50, quality_rules.BUCKETS).astype(float)
    target = np.floor(raw * rng.random(len(raw)))
    once = quality_rules.log_ratios(raw, target)
    assert once.min() >= math.log(quality_rules.PRIOR) - 1e-12
    for k in (10, 1000):
        assert np.abs(quality_rules.log_ratios(k * raw, k * target) - once).max() < 1e-12
    docs, lab = documents(spark), labels(spark, [(1, 1, 0), (9, 0, 0)])
    many = docs
    for _ in range(9):
        many = many.unionByName(docs)
    for k, d in ((1, docs), (10, many)):
        got = Counter((r.doc_id, r.n_words, round(r.llr, 9), r.kept)
                      for r in quality_rules.judge(docs, quality_rules.fit(d, lab)).collect())
        first = got if k == 1 else first
    assert got == first


def test_ngram_buckets_agree_with_a_loop():
    text = "naïve text"
    raw, out = text.encode(), []
    for i in range(len(raw) - 3):
        h = 0
        for b in raw[i:i + 4]:
            h = (h * 257 + b) % 2 ** 64
        out.append((h + 1) * 0x9E3779B97F4A7C15 % 2 ** 64 >> 48)
    assert quality_rules.ngram_buckets(text).tolist() == out


def test_quality_edges(spark):
    docs = with_clashes(documents(spark))
    lab = labels(spark, [(1, 1, 0), (None, 1, 0), (9, 0, 0), (99, 1, 1), (7, None, None), (1, 1, 0)])
    got = quality_rules.judge(docs, quality_rules.fit(docs, lab)).collect()
    assert len(got) == len(ROWS)
    assert all(r.base_failed and not r.kept and r.llr == 0 for r in got if r.doc_id in (4, 5))
    none = quality_rules.fit(docs, lab.where("quality > 5"))
    assert np.abs(none).max() < 1e-12  # no trusted texts: nothing to tell apart
    assert quality_rules.judge(documents(spark, []), none).collect() == []
    assert not quality_rules.fit(documents(spark, []), lab).any()


def test_rules_compiled_and_held_out_accuracy(spark, sf_oracle):
    docs = spark.read.parquet(f"{sf_oracle}/documents.parquet").select("doc_id", "text")
    lab = spark.read.parquet(f"{sf_oracle}/labels.parquet")
    model = rule_ensemble.fit(docs, lab)
    assert 0 < len(model.rules) < 150
    got = rule_ensemble.score(docs, model).toPandas()
    names = list(textstats.ratios())
    assert np.allclose(got["score"], model.predict(got[names].to_numpy(float), names), atol=1e-9)
    out = {r.doc_id: r for r in op4_rule_ensemble(spark, sf_oracle).collect()}
    y = {r.doc_id: r.quality for r in lab.collect()}
    held = [(out[i].predicted, q) for i, q in y.items() if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
               and r.predicted == (r.score >= 0.7) for i, r in out.items())
    for q in (0, 1):
        some = [p for p, x in held if x == q]
        assert np.mean([p == q for p in some]) >= 0.9


def test_rule_ensemble_edges(spark):
    docs = with_clashes(documents(spark))
    for rows in ([], [(1, None, None)], [(1, 1, 0), (9, 1, 0)], [(1, 1, 0), (9, 0, 0), (None, 1, 1), (1, 1, 0)]):
        model = rule_ensemble.fit(docs, labels(spark, rows))
        got = rule_ensemble.score(docs, model).collect()
        assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert rule_ensemble.score(documents(spark, []), model).collect() == []


def test_lasso_drops_noise():
    rng = np.random.default_rng(0)
    m = rng.integers(0, 2, (2000, 20)).astype(float)
    y = (m[:, 3] + 0.3 * rng.standard_normal(2000) > 0.5).astype(float)
    w, _ = rule_ensemble.lasso(m, y, 0.02)
    assert np.argmax(np.abs(w)) == 3 and (np.abs(w) > 1e-6).sum() <= 3


def lm_brute(docs, good):
    toks = {i: words((x or "").encode().lower().decode()) for i, x in docs.items()}
    size = len({w for t in toks.values() for w in t}) + 2
    seqs = {i: ["<edge>", *t, "<edge>"] for i, t in toks.items()}
    out = {i: [len(s) - 1] for i, s in seqs.items()}
    for use in (good, set(docs)):
        c, pair = Counter(), Counter()
        for i in use & set(seqs):
            c.update(seqs[i][1:])
            pair.update(zip(seqs[i], seqs[i][1:]))
        total = sum(c.values())
        for i, s in seqs.items():
            # the models of all other documents
            own_c, own = (Counter(s[1:]), Counter(zip(s, s[1:]))) if i in use else (Counter(), Counter())
            left, loss = total - sum(own_c.values()), 0.0
            for v, w in zip(s, s[1:]):
                p = (c[w] - own_c[w] + 1) / (left + size)
                loss -= math.log((pair[v, w] - own[v, w] + lm_scoring.MU * p) / (c[v] - own_c[v] + lm_scoring.MU))
            out[i].append(loss / (len(s) - 1))
    return out


def test_lm_scores_equal_brute_force(spark, sf_small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{sf_small}/labels.parquet").collect() if r.quality == 1}
    want, got = lm_brute(docs, good), op2_lm_scoring(spark, sf_small).collect()
    assert len(got) == len(docs)
    for r in got:
        assert [r.n_tokens, r.target_loss, r.background_loss] == pytest.approx(want[r.doc_id], abs=1e-9)
        assert r.score == pytest.approx(r.target_loss - r.background_loss, abs=1e-12)


def test_lm_edges(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BATCH", 3)
    rows = [r for r in ROWS if r[0] not in (7, None)]
    lab = labels(spark, [(1, 1, 0), (None, 1, 0), (9, 0, 0), (11, 1, 1), (1, 1, 0)])
    want = lm_brute({r[0]: r[1] for r in rows}, {1, 11})
    for r in lm_scoring.score(with_clashes(documents(spark, rows)), lab).collect():
        assert [r.n_tokens, r.target_loss, r.background_loss] == pytest.approx(want[r.doc_id], abs=1e-9)
    assert lm_scoring.score(documents(spark), lab).count() == len(ROWS)
    assert lm_scoring.score(documents(spark, []), lab).collect() == []
    assert lm_scoring.score(documents(spark, rows), lab.where("quality > 5")).count() == len(rows)


def test_lm_knows_every_word_of_a_large_corpus(spark):
    rng = np.random.default_rng(0)
    names = [f"name{i}" for i in range(60)]
    texts = [" ".join(rng.choice(["the", "of", "a", "to", *names], 40)) for _ in range(40)]
    texts += ["once upon rarely seen words", "twice told tale", "a twice told tale", "x " * 700_000]
    docs, good = dict(enumerate(texts)), {3, 5, 41}
    raw = Counter(w for t in docs.values() for w in t.split())
    n = sum(raw.values())
    common = {w for w in raw if raw[w] >= n / 1024}
    assert len(raw) > len(common) and sum(c < n / 2 ** 18 for c in raw.values()) > 4
    got = {r.doc_id: r for r in lm_scoring.score(documents(spark, [(i, t, "en", "a", 1) for i, t in docs.items()]),
                                                 labels(spark, [(i, 1, 0) for i in good])).collect()}
    assert len(got) == len(docs)
    for i, want in lm_brute(docs, good).items():
        assert [got[i].n_tokens, got[i].target_loss, got[i].background_loss] == pytest.approx(want, abs=1e-9)


def test_lm_bucket_is_held_once(monkeypatch):
    """The work on a bucket adds little to its messages, and pieces change no loss."""
    import tracemalloc
    rng = np.random.default_rng(1)
    n, messages = 300_000, 4
    second, run, first, doc, lens = [], [], [], [], []
    for _ in range(messages):
        w, v, r = rng.integers(-3000, 3000, n), rng.integers(0, 500, n), rng.integers(0, 1000, n)
        order = np.lexsort((r, v, w))
        w, v, r = w[order], v[order], r[order]
        begin = np.nonzero(np.concatenate(([True], w[1:] != w[:-1])))[0]
        second.append(w[begin])
        run.append(np.diff(np.append(begin, n)).astype(np.uint32))
        first.append(v)
        doc.append((r + lm_scoring.GOOD * (r % 3 == 0)).astype(np.uint16))
        lens.append(rng.integers(100, 200, len(np.unique(doc[-1]))).astype(np.uint32))
    ones = np.ones(n * messages, np.uint32)
    counts = np.full(3000, 10 * n)
    vocab = lm_scoring.Vocabulary(np.empty(0, np.int64), np.empty(0, np.int64), counts, counts * 2, 2, 6000, 10 ** 8, 10 ** 9)
    sent = [np.concatenate(x) for x in (second, run, first, doc)] + [np.full(messages, n), ones, ones, np.concatenate(lens)]
    monkeypatch.setattr(lm_scoring, "STEP", 1 << 14)
    tracemalloc.start()
    who, lost, ends = lm_scoring.bucket_losses(vocab, *sent)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * n * messages  # all messages sorted at once: more than 60 bytes an entry
    assert len(who) == ends[-1] and len(ends) == messages and np.isfinite(lost).all()
    monkeypatch.setattr(lm_scoring, "STEP", 1 << 40)
    assert all(np.array_equal(a, b) for a, b in zip((who, lost, ends), lm_scoring.bucket_losses(vocab, *sent)))


def test_lm_buckets_are_not_collected(spark, sf_small, capsys):
    op2_lm_scoring(spark, sf_small).explain()
    plan = capsys.readouterr().out
    assert "firsts" in plan and "collect_list(struct(batch" not in plan  # a bucket isn't copied into one value


def test_lm_answers_grow_with_bigrams_not_with_batches_times_buckets(spark, sf_small, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BATCH", 2)
    docs = (spark.read.parquet(f"{sf_small}/documents.parquet").limit(60).coalesce(1).selectExpr(
        "doc_id id", "coalesce(text, '') t", "doc_id % 3 = 0 good"))
    vocab = lm_scoring.fit_vocabulary(docs.select("t", "good"))
    dense = lm_scoring.common_pairs(docs, vocab)
    rows = {}
    for buckets in (8, 4000):
        rows[buckets] = lm_scoring.losses(docs, vocab, *dense, buckets).where("docs is not null").selectExpr(
            "batch", "length(docs) div 2 k", "length(sums) div 16 s").collect()
        assert all(r.k == r.s > 0 for r in rows[buckets])
        assert sum(r.k for r in rows[buckets]) <= vocab.n_raw
    assert len(rows[8]) == 30 * 8 and len(rows[4000]) < 30 * 4000 / 4


def test_lm_words_met_in_buckets(spark, sf_small, monkeypatch):
    monkeypatch.setattr(lm_scoring, "LIST_SHARE", 2.0 ** -9)
    monkeypatch.setattr(lm_scoring, "COMMON_SHARE", 2.0 ** -7)
    monkeypatch.setattr(lm_scoring, "STEP", 50)
    test_lm_scores_equal_brute_force(spark, sf_small)
