"""Toxicity by a weighted finite-state pattern grammar.

A text's words are read as letters: insult, weak insult, threat, target, negation,
reported speech, other. Small transducers rewrite the letters in context: a threat word
followed by a target becomes a threat; an insult after a target becomes a
directed insult; an insult or threat after a negation, or after a verb of
reporting, becomes a negated or reported one. Their composition is one machine
that reads each clause once and gives marks, so what is scored is matched
clauses and not words alone.

The insult lexicon is a few fixed words and what the labels teach: words, and
stems (words' beginnings), that many toxic texts and hardly any other hold. The
marks' weights are fitted to the labels by logistic regression that starts from
prior weights. Both are small and bounded; counts cover all training rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, slices, text_of
from .labels import training_rows

LETTERS = "iwhtnro"
#: Marks (plain and directed insult, threat, negated, reported, weak) and the prior
#: weights of their numbers, of the weak ones' density and of the intercept.
MARKS = "IDHNRW"
PRIOR = (4.0, 4.5, 4.5, 1.5, 1.5, 0.5, 0.3, -3.5)
PRIOR_STRENGTH = 0.5
#: A term is learned if it is in so many and so large a share of the toxic texts,
#: in so many different pairs of neighbours (copied passages have the same ones) ...
LEAST_TEXTS, LEAST_SHARE, LEAST_PLACES = 3, 0.004, 8
#: ... and at least this share of the texts that hold it are toxic.
LEAST_PRECISION = 0.9
#: ... or, as a weak insult, this share and a likelihood ratio (G2) of so much.
WEAK_PRECISION, WEAK_G2 = 0.35, 15.0
#: Lengths of stems. A stem is learned where it covers clearly more texts than its best word.
STEMS = (3, 4, 5, 6, 7, 8)
STEM_GAIN = 1.3

# Common words of the five classes.
INSULTS = """idiot idiots moron morons imbecile imbeciles stupid scum scumbag loser losers worthless pathetic
disgusting trash clown dumb dumbass bastard bastards bitch asshole vermin filth filthy idiotisch dummkopf arschloch
abschaum connard salaud imbécile pendejo cabrón gilipollas estúpido""".split()
THREATS = "kill killing murder strangle stab shoot hurt crush destroy umbringen töten tuer matar".split()
TARGETS = """you your yours yourself u he him his she her they them their these those people everyone du dich dir dein
ihr euch sie vous toi votre usted ustedes ellos""".split()
NEGATIONS = "not no never isn aren wasn don doesn didn without nicht kein keine nie pas jamais nunca jamás sin".split()
REPORTS = """said says saying called calls calling wrote writes quoted quotes told claimed reported heard sagte sagt
schrieb nannte disait écrit appelé dijo dice escribió llamó""".split()

_WORD = re.compile(r"\w+")
_CLAUSE = re.compile(r"[^.!?;\n]+")


class Machine:
    """A deterministic transducer: ``step[state][letter]`` is (output, next state)."""

    def __init__(self, step: list[dict[str, tuple[str, int]]]):
        self.step = step

    @classmethod
    def context(cls, trigger: str, span: int, outputs: dict[str, str], letters: str) -> Machine:
        """Rewrites letters by ``outputs`` where one of ``trigger`` came at most
        ``span`` letters before; a state is the number of letters still covered."""
        step = []
        for left in range(span + 1):
            row = {}
            for x in letters:
                out = outputs[x] if left and x in outputs else x
                row[x] = (out, span if x in trigger else max(0, left - 1))
            step.append(row)
        return cls(step)

    def then(self, other: Machine) -> Machine:
        """Composition: what this one puts out is what ``other`` reads."""
        number, step = {(0, 0): 0}, []
        todo = [(0, 0)]
        while todo:
            a, b = todo.pop(0)
            row = {}
            for x, (y, a2) in self.step[a].items():
                z, b2 = other.step[b][y]
                if (a2, b2) not in number:
                    number[a2, b2] = len(number)
                    todo.append((a2, b2))
                row[x] = (z, number[a2, b2])
            step.append(row)
        return Machine(step)

    def run(self, letters: str) -> str:
        state, out = 0, []
        for x in letters:
            y, state = self.step[state][x]
            out.append(y)
        return "".join(out)


def grammar() -> Machine:
    every = LETTERS + MARKS
    threat = Machine.context("h", 3, {"t": "H"}, every)
    directed = Machine.context("t", 3, {"i": "D"}, every)
    plain = Machine([{x: ({"i": "I", "w": "W"}.get(x, x), 0) for x in every}])
    negated = Machine.context("n", 2, {"I": "N", "D": "N", "H": "N"}, every)
    reported = Machine.context("r", 4, {"I": "R", "D": "R", "H": "R", "N": "R"}, every)
    return threat.then(directed).then(plain).then(negated).then(reported)


@dataclass
class Model:
    insults: frozenset = frozenset(INSULTS)
    stems: frozenset = frozenset()
    weak: frozenset = frozenset()
    weights: tuple = PRIOR
    facts: dict = field(default_factory=dict)

    def reader(self) -> Reader:
        return Reader(self)


class Reader:
    """Finds and marks a model's clauses in texts."""

    def __init__(self, model: Model):
        import ahocorasick
        self.model = model
        self.letter = {}
        for x, words in (("r", REPORTS), ("n", NEGATIONS), ("t", TARGETS), ("h", THREATS), ("i", model.insults)):
            self.letter |= dict.fromkeys(words, x)
        self.machine = grammar()
        self.hot = ahocorasick.Automaton()
        for w in {*model.insults, *THREATS, *model.stems, *(x.rstrip("-") for x in model.weak)}:
            self.hot.add_word(w, len(w))
        self.hot.make_automaton()

    def letters(self, words: list[str]) -> str:
        return "".join([self.letter.get(w) or self.stem_letter(w) for w in words])

    def stem_letter(self, word: str) -> str:
        stems, weak = self.model.stems, self.model.weak
        if any(word[:k] in stems for k in STEMS):
            return "i"
        return "w" if word in weak or any(word[:k] + "-" in weak for k in STEMS) else "o"

    def clauses(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, marks) of every clause with a mark; places are those in the
        lower-cased text."""
        low = text.lower()
        at = []
        for end, size in self.hot.iter(low):
            start = end - size + 1
            if start == 0 or not (low[start - 1].isalnum() or low[start - 1] == "_"):
                at.append(start)
        if not at:
            return []
        at.sort()
        out, k = [], 0
        for m in _CLAUSE.finditer(low):
            while k < len(at) and at[k] < m.start():
                k += 1
            if k == len(at):
                break
            if at[k] < m.end():
                got = "".join(x for x in self.machine.run(self.letters(_WORD.findall(m.group()))) if x in MARKS)
                if got:
                    out.append((m.start(), m.end(), got))
        return out

    def marks(self, text: str) -> list[int]:
        """Of each mark, the number in binary digits (0, 1, 2 for 2-3, 3 for 4-7 ...),
        and so the number of weak insults in a thousand words."""
        n = Counter("".join(c[2] for c in self.clauses(text)))
        dense = 1000 * n["W"] // len(_WORD.findall(text)) if n["W"] else 0
        return [*(n[x].bit_length() for x in MARKS), dense.bit_length()]

    def score(self, marks: list[int]) -> float:
        w = self.model.weights
        z = w[-1] + sum(a * b for a, b in zip(w, marks))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _terms(text: str) -> set[str]:
    """Words (as they are) and stems (with a hyphen behind) of a text."""
    words = {w for w in _WORD.findall(text.lower()) if len(w) >= 3}
    return words | {w[:k] + "-" for k in STEMS for w in words if len(w) > k}


def _count(rows: DataFrame, only: frozenset | None = None) -> DataFrame:
    def run(batches):
        n = Counter()
        for b in slices(batches, 256):
            for x in b.column(0).to_pylist():
                n.update(_terms(x) if only is None else _terms(x) & only)
            if len(n) > 500_000:
                yield pa.RecordBatch.from_pydict({"term": list(n), "n": list(n.values())})
                n.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["term", "n"])

    return rows.select("t").mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def _contexts(rows: DataFrame, only: frozenset) -> DataFrame:
    """(term, n): in how many different pairs of neighbouring words a term stands."""
    def run(batches):
        for b in slices(batches, 256):
            seen = set()
            for x in b.column(0).to_pylist():
                words = ["", *_WORD.findall(x.lower()), ""]
                for p, w, q in zip(words, words[1:], words[2:]):
                    for t in (w, *(w[:k] + "-" for k in STEMS if len(w) > k)):
                        if t in only:
                            seen.add((t, p, q))
            cols = list(zip(*seen)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["term", "p", "q"])

    return (rows.select("t").mapInArrow(run, "term string, p string, q string")
            .groupBy("term", "p", "q").count().groupBy("term").agg(F.count("*").alias("n")))


def _g2(n: int, m: int, pos: int, neg: int) -> float:
    """Log-likelihood ratio of a term in n of pos toxic and m of neg other texts."""
    part = lambda k, e: k * math.log(k / e) if k else 0.0
    share = (n + m) / (pos + neg)
    return 2 * (part(n, pos * share) + part(m, neg * share) + part(pos - n, pos * (1 - share)) + part(neg - m, neg * (1 - share)))


def learn_lexicon(held: dict[str, int], others: dict[str, int], pos: int, neg: int) -> tuple[set, set, set]:
    """(words, stems, weak terms) from the numbers of toxic and other texts, of pos
    and neg, that hold each term."""
    share = {t: n / (n + others.get(t, 0) + 0.1) for t, n in held.items()}
    good = {t: n for t, n in held.items() if share[t] >= LEAST_PRECISION}
    best_word = Counter()
    for t, n in held.items():
        if not t.endswith("-"):
            for k in STEMS:
                best_word[t[:k]] = max(best_word[t[:k]], n)
    stems = {t[:-1] for t, n in good.items() if t.endswith("-") and n >= STEM_GAIN * max(1, best_word[t[:-1]])}
    # of stems within each other that cover about the same texts, the longest
    for s in sorted(stems, key=len):
        if any(x != s and x.startswith(s) and good[x + "-"] >= 0.95 * good[s + "-"] for x in stems):
            stems.discard(s)
    words = {t for t in good if not t.endswith("-") and not any(t[:k] in stems for k in STEMS)}
    weak: list[str] = []
    worth = {t: _g2(n, others.get(t, 0), pos, neg) for t, n in held.items()
             if t not in good and share[t] >= WEAK_PRECISION
             and not any(w.startswith(t.rstrip("-")) and n < STEM_GAIN * good[w] for w in words)}
    for t in sorted(worth, key=lambda t: (-worth[t], -len(t), t)):
        body = t.rstrip("-")
        if worth[t] >= WEAK_G2 and not any(body.startswith(x.rstrip("-")) or x.startswith(body) for x in weak):
            weak.append(t)
    return words, stems, set(weak)


def fit_weights(rows: list[tuple[list[int], int, int]], prior=PRIOR, strength: float = PRIOR_STRENGTH) -> tuple:
    """Logistic regression by Newton steps on (marks, label, count) rows, drawn
    towards the prior weights."""
    if not rows:
        return tuple(prior)
    x = np.array([[*r[0], 1] for r in rows], float)
    y, n = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    w = w0 = np.array(prior, float)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (n * (p - y)) + strength * (w - w0)
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2 / max(1e-9, np.abs(step).max()))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic",
        folds: int = 3, held_out: int = 1) -> Model:
    """The model from the labelled rows outside the held-out fold. Without toxic
    training rows: the fixed words and prior weights."""
    rows = training_rows(docs, labels, label, folds, held_out, id_col, text_col)
    pos, neg = rows.where("y = 1"), rows.where("y != 1")
    n_pos = pos.count()
    if n_pos == 0:
        return Model()
    least = max(LEAST_TEXTS, math.ceil(LEAST_SHARE * n_pos))
    # a text holds a bounded number of terms, and a term needs a fixed share of the
    # texts: the candidates are at most 1 / LEAST_SHARE times the terms of a text
    held = {r.term: r.n for r in _count(pos).where(F.col("n") >= least).collect()}
    fixed = set(INSULTS)
    others = {r.term: r.n for r in _count(neg, frozenset(held) | fixed).collect()}
    likely = frozenset(t for t, n in held.items() if n / (n + others.get(t, 0) + 0.1) >= WEAK_PRECISION)
    places = {r.term: r.n for r in _contexts(pos, likely).where(F.col("n") >= max(least, LEAST_PLACES)).collect()}
    apart = {t: min(n, places[t]) for t, n in held.items() if t in places}
    words, stems, weak = learn_lexicon(apart, others, n_pos, rows.count() - n_pos)
    contradicted = {w for w in fixed if others.get(w, 0) > held.get(w, 0)}
    model = Model(frozenset((fixed - contradicted) | words), frozenset(stems), frozenset(weak))
    marked = _marked(rows.select("id", "y", "t"), model, ["id", "y"])
    table = marked.groupBy("marks", F.col("y") == 1).count().collect()
    model.weights = fit_weights([(list(r[0]), int(r[1]), r[2]) for r in table])
    model.facts = {"toxic": n_pos, "words": len(words), "stems": len(stems), "weak": len(weak)}
    return model


def _marked(src: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep``, marks and score; the text is the column t."""
    kinds = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        reader = model.reader()
        for b in slices(batches, 512):
            marks = [reader.marks(x) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(keep))), pa.array(marks, pa.list_(pa.int32())),
                 pa.array([reader.score(m) for m in marks], pa.float64())], [*keep, "marks", "score"])

    return src.select(*keep, "t").mapInArrow(run, f"{kinds}, marks array<int>, score double")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, marks, score) for every row: marks are the numbers (in binary digits) of
    insults, directed insults, threats, negated and reported ones in its clauses;
    score is the probability of the toxic label. NULL and empty texts have no marks."""
    out = _marked(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t")), model, ["id"])
    return out.withColumnRenamed("id", id_col)


def matched_clauses(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, marks): the clauses that count, with places in the
    lower-cased text."""
    src = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))

    def run(batches):
        reader = model.reader()
        for b in slices(batches, 512):
            found = [(i, *c) for i, x in enumerate(b.column(1).to_pylist()) for c in reader.clauses(x)]
            cols = list(zip(*found)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()),
                 pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], ["id", "start", "end", "marks"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, start int, end int, marks string").withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more, all columns kept."""
    model = fit(docs, labels, id_col, text_col)
    names = docs.columns
    reader = None

    def run(batches):
        nonlocal reader
        reader = reader or model.reader()
        at = names.index(text_col)
        for b in slices(batches, 512):
            keep = [reader.score(reader.marks(x or "")) < threshold for x in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 3, held_out: int = 1) -> DataFrame:
    model = fit(docs, labels, folds=folds, held_out=held_out)
    return score(docs, model).select(
        "doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "marks")
