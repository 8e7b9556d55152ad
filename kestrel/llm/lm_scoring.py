"""LM scoring by cross-entropy difference.

Two bigram models, one of the target texts (documents labelled good) and one of
the background (all documents), share one vocabulary, order and smoothing:
p(w | v) = (c(v, w) + MU * p(w)) / (c(v) + MU), p(w) the model's unigram. A
document's score is its mean loss per token under the target model less that
under the background model: the lower, the more it is like the target. A document is
scored by the models of all other rows: its own occurrences are left out of every
count, of bigrams, first words, unigrams and totals, be its words rare or common.

The vocabulary holds every word of the corpus, by its hash; no word is cut, however
rare or large the corpus. Listed words, those that make up at least ``LIST_SHARE`` of
the corpus (so at most 1 / LIST_SHARE), are broadcast with their counts. Bigram counts
are neither pruned nor broadcast, but met by key: a task sends, for a batch of
documents, its bigrams sorted into buckets, with the documents that hold them and
their own counts; a bucket's task has all of a bigram's counts and answers with one
pair of losses for each document that sent it something. So answers are never more
than the bigrams sent, however many batches and buckets there are. A
bigram whose second word is not listed goes to the bucket of that word: every
occurrence of a word is the second of one bigram, so the bucket has the word's own
counts too, and as each is also the first of one, adds the losses' share that hangs
on the first word's count. Bigrams of two common words, which are the largest
shares, are counted in a dense table instead (at most 1 / COMMON_SHARE squared
cells). A key in a bucket holds less than COMMON_SHARE of all bigrams.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common
from .common import ascii_words, checked_broadcast, cut, partitions, slices, text_of

#: Every word is known: neither a share of the corpus nor a second occurrence is asked for.
VOCAB_SHARE, LEAST_COUNT = 0.0, 1
#: Share from which a word's counts are broadcast; others are met in buckets.
LIST_SHARE = 2.0 ** -18
COMMON_SHARE = 2.0 ** -10
MU = 50.0
#: Documents of a batch, and bigram tokens of a bucket, about.
BATCH, BUCKET_TOKENS = 1024, 2_000_000
#: Entries of a bucket that are worked on at a time, about: whole words.
STEP = 1 << 17
#: Number of a text's start and end; 0 is kept for a word outside the corpus.
EDGE = 1
#: Marks, in a batch's document numbers, those of the target.
GOOD = 1 << 15


@dataclass
class Vocabulary:
    """Words by the XXH64 of their lower-cased form. Listed words have numbers, by
    falling count from 2; any other word's key is its hash with the sign bit set."""
    hashes: np.ndarray  # of the listed words, sorted
    numbers: np.ndarray  # of the sorted hashes
    target: np.ndarray  # counts by number
    raw: np.ndarray
    common: int  # numbers below this are common
    n_words: int  # different words of the corpus
    n_target: int  # tokens and texts' ends
    n_raw: int

    def unigram(self, counts: np.ndarray, total: int) -> np.ndarray:
        return (counts + 1.0) / (total + self.n_words + 2)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word keys, row) of the tokens of all texts, in order."""
        index, hashes = word_index(texts)
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        listed = (self.hashes[at] == hashes) if len(self.hashes) else np.zeros(len(hashes), bool)
        key = np.where(listed, self.numbers[at] if len(self.hashes) else 0, hashes | np.iinfo(np.int64).min)
        sizes = [len(x) for x in index]
        flat = np.fromiter((i for x in index for i in x), np.int64, sum(sizes))
        return key[flat], np.repeat(np.arange(len(texts)), sizes)

    def bigrams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, second, row); every text begins and ends with the edge, so a text
        of n words has n + 1 bigrams."""
        w, row = self.texts(texts)
        n = np.bincount(row, minlength=len(texts)) + 1
        ends = np.cumsum(n)
        second = np.full(ends[-1] if len(ends) else 0, EDGE, np.int64)
        inner = np.ones(len(second), bool)
        inner[ends - 1] = False
        second[inner] = w
        first = np.concatenate(([EDGE], second[:-1])) if len(second) else second
        return first, second, np.repeat(np.arange(len(texts)), n)


def word_index(texts: list[str]) -> tuple[list[list[int]], np.ndarray]:
    from xxhash import xxh64_intdigest
    number: dict[bytes, int] = {}
    index = [[number.setdefault(w, len(number)) for w in ascii_words(x, lower=True)] for x in texts]
    return index, np.fromiter(map(xxh64_intdigest, number), np.uint64, len(number)).view(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, raw, target) over all rows of ``docs`` (t, good); words as hashes."""
    def run(batches):
        for b in slices(batches, 4096):
            texts, good = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), bool)
            index, hashes = word_index(texts)
            sizes = [len(x) for x in index]
            flat = np.fromiter((i for x in index for i in x), np.int64, sum(sizes))
            mine = np.repeat(good, sizes)
            raw = np.bincount(flat, minlength=len(hashes))
            target = np.bincount(flat[mine], minlength=len(hashes))
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(raw), pa.array(target)], ["word", "raw", "target"])

    return (docs.mapInArrow(run, "word bigint, raw bigint, target bigint").groupBy("word")
            .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))


def fit_vocabulary(docs: DataFrame) -> Vocabulary:
    n_docs, n_good = docs.agg(F.count("*"), F.count_if("good")).first()
    words = cut(word_counts(docs))
    n_words, raw, target = words.agg(F.count("*"), F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0))).first()
    # at most 1 / LIST_SHARE rows
    rows = (words.where(F.col("raw") >= min(LIST_SHARE, COMMON_SHARE) * raw).toPandas()
            .sort_values(["raw", "word"], ascending=[False, True]))
    h, c, t = (rows[k].to_numpy(np.int64) for k in ("word", "raw", "target"))
    order = np.argsort(h)
    counts, wanted = np.concatenate(([0, n_docs], c)), np.concatenate(([0, n_good], t))
    return Vocabulary(h[order], order + 2, wanted, counts, 2 + int((c >= COMMON_SHARE * max(1, raw)).sum()),
                      n_words, target + n_good, raw + n_docs)


def common_pairs(docs: DataFrame, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Dense (target, raw) counts of the bigrams of two common words."""
    k = vocab.common

    def run(batches):
        raw, target = np.zeros(k * k, np.int64), np.zeros(k * k, np.int64)
        for b in slices(batches, BATCH):
            v, w, row = vocab.bigrams(b.column(0).to_pylist())
            both = (v >= 0) & (v < k) & (w >= 0) & (w < k)
            cell, good = v[both] * k + w[both], np.array(b.column(1).to_pylist(), bool)[row[both]]
            raw += np.bincount(cell, minlength=k * k)
            target += np.bincount(cell[good], minlength=k * k)
        at = np.nonzero(raw)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["cell", "raw", "target"])

    rows = (docs.select("t", "good").mapInArrow(run, "cell bigint, raw bigint, target bigint").groupBy("cell")
            .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas())
    raw, target = np.zeros(k * k), np.zeros(k * k)
    raw[rows["cell"].to_numpy()], target[rows["cell"].to_numpy()] = rows["raw"].to_numpy(), rows["target"].to_numpy()
    return target.reshape(k, k), raw.reshape(k, k)


def own_counts(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each token how often its key stands in its own row."""
    order = np.lexsort((key, row))
    k, r = key[order], row[order]
    run = np.cumsum(np.concatenate(([True], (k[1:] != k[:-1]) | (r[1:] != r[:-1]))))[: len(k)] - 1
    out = np.empty(len(key), np.int64)
    out[order] = np.bincount(run)[run] if len(run) else 0
    return out


def pair_loss(pair: np.ndarray, unigram: np.ndarray) -> np.ndarray:
    """The part of -log p(w | v) that hangs on the bigram's count and w's unigram."""
    return -np.log(pair + MU * unigram)


def first_loss(count: np.ndarray) -> np.ndarray:
    """The part of -log p(w | v) that hangs on v's count."""
    return np.log(count + MU)


def losses(src: DataFrame, vocab: Vocabulary, dense_target: np.ndarray, dense_raw: np.ndarray, buckets: int) -> DataFrame:
    """(batch, ids, n, docs, sums) for ``src`` (id, t, good): for each batch one row with
    its ids, their numbers of tokens and the losses known without a bucket (docs is
    NULL), and one for each bucket it sent bigrams to, with the numbers in the
    batch of the documents concerned and their losses, target before background."""
    kind = src.schema["id"].dataType.simpleString()
    k, width = vocab.common, len(vocab.raw)

    def send(batches):
        from pyspark import TaskContext
        part, no = TaskContext.get().partitionId(), -1
        for b in slices(batches, BATCH):
            no += 1
            batch = part * (1 << 32) + no
            good = np.array(b.column(2).to_pylist(), np.int64)
            v, w, row = vocab.bigrams(b.column(1).to_pylist())
            n = np.bincount(row, minlength=len(good))
            own_w = own_counts(w, row)
            # a text's first words are its second ones, moved by one; its edge stands once
            own_v = np.concatenate(([1], own_w[:-1]))
            own_v[np.cumsum(n)[:-1]] = 1
            both = (v >= 0) & (v < k) & (w >= 0) & (w < k)
            x, y, r = v[both], w[both], row[both]
            own_pair, own_y = own_counts(x * k + y, r), own_w[both]
            listed = v >= 0
            x1, r1, own_x1 = v[listed], row[listed], own_v[listed]
            sums = np.concatenate([
                np.bincount(r, pair_loss(d[x, y] - f[r] * own_pair, vocab.unigram(c[y] - f[r] * own_y, total - f[r] * n[r])),
                            minlength=len(good))
                + np.bincount(r1, first_loss(c[x1] - f[r1] * own_x1), minlength=len(good)) for d, c, total, f in (
                    (dense_target, vocab.target, vocab.n_target, good),
                    (dense_raw, vocab.raw, vocab.n_raw, np.ones_like(good)))])
            out = [(batch % buckets, *[None] * 7, b.column(0).to_pylist(), n.tolist(), sums.tobytes())]
            v, w, r, own = v[~both], w[~both], row[~both], own_w[~both]
            if len(v):
                # by the second word if it isn't listed, else by the pair
                mixed = np.where(w < 0, w, v * width + w).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                to = ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((r, v, w, to))
                v, w, r, to, own = v[order], w[order], r[order], to[order], own[order]
                new = np.concatenate(([True], (w[1:] != w[:-1]) | (v[1:] != v[:-1]) | (r[1:] != r[:-1])))
                at = np.nonzero(new)[0]
                times = np.diff(np.append(at, len(v))).astype(np.uint32)
                v, w, r, to, own = v[at], w[at], r[at], to[at], own[at].astype(np.uint32)
                doc = (r + GOOD * good[r]).astype(np.uint16)
                edge = np.nonzero(np.concatenate(([True], to[1:] != to[:-1], [True])))[0]
                for i, j in zip(edge[:-1], edge[1:]):
                    begin = np.nonzero(np.concatenate(([True], w[i + 1:j] != w[i:j - 1])))[0]
                    runs = np.diff(np.append(begin, j - i)).astype(np.uint32)
                    lens = n[np.unique(doc[i:j]) % GOOD].astype(np.uint32)
                    out.append((int(to[i]), w[i + begin].tobytes(), runs.tobytes(), v[i:j].tobytes(), doc[i:j].tobytes(),
                                times[i:j].tobytes(), own[i:j].tobytes(), lens.tobytes(), None, None, None))
            cols = list(zip(*out))
            types = [pa.int32(), *[pa.binary()] * 7, pa.list_(b.column(0).type), pa.list_(pa.int64()), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(cols, types)]
            yield pa.RecordBatch.from_arrays([arrays[0], pa.array([batch] * len(out), pa.int64()), *arrays[1:]],
                                             ["bucket", "batch", *fields])

    packed = ["seconds", "runs", "firsts", "docs", "times", "own", "lens"]
    fields = [*packed, "ids", "n", "sums"]
    sent = src.mapInArrow(send, f"bucket int, batch bigint, {', '.join(f'{c} binary' for c in packed)}, "
                                f"ids array<{kind}>, n array<bigint>, sums binary")
    # a bucket is a partition of its own: its rows are read as they come, not collected
    met = sent.repartitionById(buckets, "bucket").drop("bucket")
    names = ["batch", "ids", "n", "docs", "sums"]

    def count(batches):
        bucket: dict[str, list] = {c: [] for c in ("batch", *packed)}
        for b in batches:
            batch, *cols = (b.column(i) for i in range(b.num_columns))
            full = cols[2].is_valid()
            base = b.filter(pa.compute.invert(full))
            yield pa.RecordBatch.from_arrays([base.column("batch"), base.column("ids"), base.column("n"),
                                              pa.nulls(base.num_rows, pa.binary()), base.column("sums")], names)
            if base.num_rows < b.num_rows:
                bucket["batch"] += batch.filter(full).to_pylist()
                for c, x in zip(packed, cols):
                    bucket[c].append(x)
        if bucket["batch"]:
            second, run, v, doc, m, own, size = (laid_out(bucket.pop(c), t) for c, t in zip(packed, (
                np.int64, np.uint32, np.int64, np.uint16, np.uint32, np.uint32, np.uint32)))
            who, sums, ends = bucket_losses(vocab, second[0], run[0], v[0], *doc, m[0], own[0], size[0])
            parts = list(zip(bucket["batch"], np.concatenate(([0], ends[:-1])), ends))
            for some in (parts[k:k + 1024] for k in range(0, len(parts), 1024)):
                yield pa.RecordBatch.from_arrays([
                    pa.array([no for no, _, _ in some], pa.int64()), pa.nulls(len(some), pa.list_(id_type)),
                    pa.nulls(len(some), pa.list_(pa.int64())), pa.array([who[i:j].tobytes() for _, i, j in some], pa.binary()),
                    pa.array([sums[:, i:j].tobytes() for _, i, j in some], pa.binary())], names)

    id_type = to_arrow_type(src.schema["id"].dataType)
    return met.mapInArrow(count, f"batch bigint, ids array<{kind}>, n array<bigint>, docs binary, sums binary")


def laid_out(columns: list, kind) -> tuple[np.ndarray, np.ndarray]:
    """(the numbers packed in the binary values of all ``columns``, one after the other, how
    many each value that isn't NULL holds). Of one column they are a view, not a copy."""
    parts, sizes = [], []
    for c in columns:
        off = np.frombuffer(c.buffers()[1], np.int64 if pa.types.is_large_binary(c.type) else np.int32)[c.offset:c.offset + len(c) + 1]
        data = c.buffers()[2]
        parts.append(np.frombuffer(data, np.uint8)[off[0]:off[-1]].view(kind) if data else np.empty(0, kind))
        sizes.append((np.diff(off) // np.dtype(kind).itemsize)[c.is_valid().to_numpy(zero_copy_only=False)])
    return parts[0] if len(parts) == 1 else np.concatenate(parts), np.concatenate(sizes)


def bucket_losses(vocab: Vocabulary, second: np.ndarray, run: np.ndarray, v: np.ndarray, doc: np.ndarray, n_entries: np.ndarray,
                  m: np.ndarray, own: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents of each message in turn, their losses, target before background, the messages'
    ends) for all messages of a bucket, as ``losses`` sends them: a message holds
    ``n_entries`` entries (first word ``v``, document, times ``m`` and the second word's count
    ``own`` in it), in runs of the same ``second`` word, by rising words; ``lens`` has the tokens of its
    documents. Whole words of ``STEP`` entries about are worked on at a time, so what is
    held beside the messages is little."""
    place, who, ends, begin = np.empty(len(v), np.int32), [], [0], 0
    for k in n_entries.tolist():
        u, j = np.unique(doc[begin:begin + k], return_inverse=True)
        place[begin:begin + k] = j + ends[-1]
        who.append(u)
        ends.append(ends[-1] + len(u))
        begin += k
    who = np.concatenate(who)
    good, lost = who >= GOOD, np.zeros((2, len(who)))
    at = np.cumsum(run, dtype=np.int64) - run
    order = np.argsort(second, kind="stable")
    upto = np.cumsum(run[order], dtype=np.int64)
    # the runs of the words that hold every STEP-th entry begin a piece
    word = second[order][np.searchsorted(upto, np.arange(0, len(v), STEP), "right")]
    cuts = np.append(np.searchsorted(second, np.unique(word), sorter=order), len(order))
    for i, j in zip(cuts[:-1], cuts[1:]):
        o = order[i:j]
        k = run[o].astype(np.int64)
        e = np.repeat(at[o] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        y = np.repeat(second[o], k)
        by = np.lexsort((v[e], y))
        e, y = e[by], y[by]
        x, p = v[e], place[e]
        times, left, long = m[e].astype(np.int64), own[e].astype(np.int64), lens[p].astype(np.int64)
        other = np.concatenate(([True], y[1:] != y[:-1]))
        pair = np.cumsum(other | np.concatenate(([True], x[1:] != x[:-1]))) - 1
        word = np.cumsum(other) - 1
        rare = y < 0
        number = np.where(rare, 0, y)
        for model, (f, counts, total) in enumerate(((good[p].astype(np.int64), vocab.target, vocab.n_target),
                                                    (1, vocab.raw, vocab.n_raw))):
            mine = times * f
            c = np.where(rare, np.bincount(word, mine)[word], counts[number]) - f * left
            np.add.at(lost[model], p, times * (pair_loss(np.bincount(pair, mine)[pair] - mine, vocab.unigram(c, total - f * long))
                                               + np.where(rare, first_loss(c), 0.0)))
    return (who % GOOD).astype(np.uint16), lost, np.array(ends[1:])


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, target_loss, background_loss, score) for every row.

    n_tokens counts the words and the text's end, so a NULL or empty text has one.
    Losses are nats per token; score is target_loss - background_loss. Target texts
    are those with a label of 1; without any the target model is uniform. Repeated
    rows and copies are rows of their own, and stay in each other's models.
    """
    spark = docs.sparkSession
    good = cut(labels.where(F.col(label) == 1).where(F.col(id_col).isNotNull())
               .select(F.col(id_col).alias("lid"), F.lit(True).alias("good")).distinct())
    src = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    n_good = good.count()
    src = (src.join(checked_broadcast(good, n_good), F.col("id") == F.col("lid"), "left")
           .select("id", "t", F.coalesce("good", F.lit(False)).alias("good")))
    if n_good > common.BROADCAST_ROWS:
        # batches are made by row order, which a shuffled join alone does not fix;
        # a task that runs again must make the same ones
        src = src.sortWithinPartitions("id", F.xxhash64("t"))
    kind = src.schema["id"].dataType.simpleString()
    vocab = fit_vocabulary(src.select("t", "good"))
    dense_target, dense_raw = common_pairs(src, vocab)
    buckets = max(partitions(spark), math.ceil(vocab.n_raw / BUCKET_TOKENS))
    back = losses(src, vocab, dense_target, dense_raw, buckets)
    whole = back.groupBy("batch").agg(
        F.first("ids", True).alias("ids"), F.first("n", True).alias("n"),
        F.collect_list(F.struct("docs", "sums")).alias("sums")).select("ids", "n", "sums")

    def add(batches):
        for b in slices(batches, 16):
            for ids, n, sums in zip(*(b.column(i) for i in range(3))):
                n = np.array(n.as_py(), np.int64)
                total = np.zeros((2, len(n)))
                for d, x in zip(*sums.values.flatten()):
                    at = np.frombuffer(d.as_buffer(), np.uint16) if d.is_valid else slice(None)
                    total[:, at] += np.frombuffer(x.as_buffer(), np.float64).reshape(2, -1)
                mean = total / np.maximum(1, n)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(n), *map(pa.array, mean), pa.array(mean[0] - mean[1])],
                                                 ["id", "n_tokens", "target_loss", "background_loss", "score"])

    return whole.mapInArrow(add, f"id {kind}, n_tokens bigint, target_loss double, background_loss double, score double") \
        .withColumnRenamed("id", id_col)
