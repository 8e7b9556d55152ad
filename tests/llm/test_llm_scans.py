import os
import random
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from data import ROWS, documents, labels, with_clashes  # noqa: E402

from kestrel.llm import licenses, toxicity  # noqa: E402
from kestrel.llm.labels import training_rows  # noqa: E402
from kestrel.llm.queries import op7_licenses, op8_toxicity  # noqa: E402


# licences

def test_matching_statistics_equal_brute_force():
    rng = random.Random(3)
    some = ["alpha", "beta", "gamma", "delta", "and"]
    for _ in range(200):
        temps = [("x", " ".join(rng.choice(some) for _ in range(rng.randint(4, 14)))) for _ in range(3)]
        scanner = licenses.Scanner(temps)
        doc = [rng.choice(some).encode() for _ in range(30)] + licenses.words_of(temps[0][1])[1:8]
        ids = scanner.numbers(doc)
        if (ids < 0).any():
            continue
        got = sorted(scanner.automaton.matches(ids.tolist(), 0))
        words = [licenses.words_of(t) for _, t in temps]
        want = []
        for end in range(1, len(doc) + 1):
            for k, t in enumerate(words):
                for i in range(len(t)):
                    n = 0
                    while n <= i and n < end and t[i - n] == doc[end - 1 - n]:
                        n += 1
                    if n >= 4 and (end == len(doc) or i + 1 == len(t) or t[i + 1] != doc[end]):
                        want.append((end, n, (k, i)))
        assert got == sorted(want)


def plain_words(text):
    out, word = [], ""
    for c in text or "":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c <= "\x2f" or "\x3a" <= c <= "\x60" or "\x7b" <= c <= "\x7f":
            out.append(word)
            word = ""
        else:
            word += c
    return [w for w in [*out, word] if w]


def license_base(text):
    w = plain_words(text)
    at = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w))
          if w[i:i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in at]
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def check_licenses(got, rows):
    assert len(got) == len(rows)
    want = sorted((repr(i), repr(license_base(t))) for i, t in rows)
    assert sorted((repr(r.doc_id), repr((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))) for r in got) == want
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert r.labels == ",".join(sorted(set(r.labels.split(","))))


def test_licenses_whole_table(spark, sf_small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    check_licenses(op7_licenses(spark, sf_small).collect(), rows)


def test_licenses_edges(spark):
    rows = [*ROWS, (40, "MIT-License mit  license; Apache\nLICENSE general public license xmit license", "en", "a", 1),
            (41, "Licensed under the Apache License, Version 2.0 (the \"License\"); you MUST not use this file except in"
                 " compliance with the License.", "en", "a", 1)]
    got = licenses.scan(with_clashes(documents(spark, rows))).collect()
    check_licenses(got, [(r[0], r[1]) for r in rows])
    by = {r.doc_id: r for r in got}
    assert by[40].n_base == 4 and by[12].labels == "cc-by-nc-4.0,mit" and by[41].labels == "apache,apache-2.0"
    spans = {(r.doc_id, r.label) for r in licenses.find_spans(documents(spark, rows)).collect()}
    assert {(12, "mit"), (12, "cc-by-nc-4.0"), (41, "apache-2.0")} <= spans
    assert licenses.scan(documents(spark, [])).collect() == []


# toxicity

@pytest.mark.parametrize("letters, marks", [
    ("ooioo", "I"), ("toi", "D"), ("tooooi", "I"), ("noi", "N"), ("nooi", "I"), ("rooi", "R"), ("roooooi", "I"), ("hot", "H"),
    ("hoooot", ""), ("h", ""), ("nti", "N"), ("rnti", "R"), ("ii", "II"), ("wow", "WW"), ("", ""), ("nhot", "H"), ("htn", "H")])
def test_grammar(letters, marks):
    assert "".join(x for x in toxicity.grammar().run(letters) if x in toxicity.MARKS) == marks


def test_composition_equals_running_one_after_the_other():
    rng = random.Random(1)
    every = toxicity.LETTERS + toxicity.MARKS
    a = toxicity.Machine.context("t", 3, {"i": "D"}, every)
    b = toxicity.Machine.context("n", 2, {"D": "N", "i": "N"}, every)
    for _ in range(300):
        x = "".join(rng.choice("itno") for _ in range(rng.randint(0, 12)))
        assert a.then(b).run(x) == b.run(a.run(x))


def test_clauses_and_scores():
    r = toxicity.Model().reader()
    assert [c[2] for c in r.clauses("All fine. You absolute IDIOT! He said you are a moron; not stupid.\nok")] == ["D", "R", "N"]
    assert r.score(r.marks("you idiot")) > 0.5 > r.score(r.marks("he said no idiot")) > r.score(r.marks("idiotic weather"))
    assert r.marks("") == [0] * 7


def test_held_out_accuracy(spark, sf_oracle):
    got = {r.doc_id: r for r in op8_toxicity(spark, sf_oracle).collect()}
    lab = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_oracle}/labels.parquet").collect()}
    held = {i: y for i, y in lab.items() if zlib.crc32(str(i).encode()) % 3 == 1}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for i, r in got.items())
    toxic, clean = [i for i, y in held.items() if y], [i for i, y in held.items() if not y]
    assert np.mean([got[i].predicted for i in toxic]) >= 0.75
    assert np.mean([got[i].predicted for i in clean]) <= 0.02


def test_lexicon():
    held = {"insultwort": 10, "insu-": 12, "stem-": 30, "stema": 9, "stemb": 8, "often": 9, "weak-": 20}
    words, stems, weak = toxicity.learn_lexicon(held, {"often": 300, "weak-": 25, "insu-": 60}, 100, 900)
    assert words == {"insultwort"} and stems == {"stem"} and weak == {"weak-"}


def test_weights_follow_the_labels():
    zero = [0] * 7
    w = toxicity.fit_weights([([1, *zero[1:]], 0, 500), (zero, 0, 500), ([0, 1, *zero[2:]], 1, 500)])
    model = toxicity.Model(weights=w)
    r = model.reader()
    assert r.score([1, *zero[1:]]) < 0.1 and r.score([0, 1, *zero[2:]]) > 0.9
    assert toxicity.fit_weights([]) == toxicity.PRIOR


def test_toxicity_edges(spark):
    docs = with_clashes(documents(spark))
    for rows in ([], [(1, 1, None)], [(11, 1, 1), (1, 1, 0), (None, 1, 1), (11, 0, 0), (999, 1, 1)]):
        model = toxicity.fit(docs, labels(spark, rows))
        got = toxicity.score(docs, model).collect()
        assert len(got) == len(ROWS)
        assert all(r.score < 0.7 for r in got if r.doc_id in (4, 5, 6, 7, 1)) and any(r.score >= 0.7 for r in got if r.doc_id == 11)
    kept = toxicity.without_toxic(docs, labels(spark, []))
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 1
    assert toxicity.without_toxic(documents(spark, []), labels(spark, [])).collect() == []
    spans = toxicity.matched_clauses(docs, toxicity.Model()).collect()
    assert {r.doc_id for r in spans} == {11}


def test_training_rows_keep_texts_that_share_a_passage(spark):
    passage = " ".join(f"shared{i}" for i in range(200))
    rows = [(i, f"{passage} own{i} words{i}", "en", "a", 1) for i in range(60)]
    rows += [(100 + i, "An  exact copy\nof you idiot" if i % 2 else "an exact copy of you IDIOT", "en", "a", 1) for i in range(20)]
    lab = labels(spark, [(r[0], 0, int(r[0] % 3 == 0)) for r in rows])
    got = training_rows(documents(spark, rows), lab, "toxic", 3, 1).collect()
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    assert {r.id for r in got if r.id < 100} == {r[0] for r in train if r[0] < 100}
    copies = [r[0] for r in train if r[0] >= 100]
    assert {r.id for r in got if r.id >= 100} == {min(i for i in copies if (i % 3 == 0) == y) for y in (True, False)}
