"""Byte-level BPE encoding and decoding by tree concatenation.

A text is one long unsplit run for the merge rules, so a document far longer
than the rest would keep one task busy. Here long texts are cut into leaves
that are encoded as rows of their own, on any executor, and the encodings are
joined pairwise, level by level, up to the whole text.

Joining two encodings ``L`` and ``R``: the tokens next to the join are decoded
to their bytes and that window is encoded anew. If the window and ``L`` share a
token (same id, same bytes) before the join, and the window and ``R`` share one
after it, the result is ``L`` up to the first shared token, the window up to the
second, then ``R``. Otherwise the window grows to twice as many tokens; a window
that reaches the end of a side needs no shared token there.

Why that is exact: the words that the splitting pattern finds after a position
depend only on the run of like characters at it, so two scans that share a
token go on alike; and within a word a token sequence is the BPE encoding
exactly if each two neighbours are the encoding of their own concatenation,
which holds for neighbours taken from any valid encoding. Only the last few
characters before a cut can differ (``'re`` cut after ``'r``, a special token's
name cut in its middle), so shared tokens must end ``MARGIN`` bytes before it.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, slices, text_of

#: Longer texts are cut into leaves of so many characters.
LEAF_CHARS = 16_384
#: Tokens on either side of a join in the first window.
WINDOW = 48
#: Bytes; no splitting rule looks further ahead: the longest special token is shorter.
MARGIN = 32


@lru_cache(maxsize=4)
def load(path: str):
    """(encoder, bytes of each id) of a byte-level BPE file in the tokenizers
    library's JSON format; special tokens in a text are recognised, as there."""
    import tiktoken
    from public_tokenizers import PATTERN
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # the byte alphabet of byte-level BPE: printable Latin-1 stands for itself,
    # the other bytes follow from code point 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(b): b for b in plain}
    alphabet |= {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
    ranks = {}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    for token, i in spec["model"]["vocab"].items():
        if token not in special:
            ranks[bytes(alphabet[c] for c in token)] = i
    if max(map(len, special), default=0) > MARGIN:
        raise ValueError("a special token is longer than MARGIN")
    enc = tiktoken.Encoding("kestrel", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    table = [b""] * (max([*ranks.values(), *special.values()]) + 1)
    for token, i in ranks.items():
        table[i] = token
    for token, i in special.items():
        table[i] = token.encode()
    return enc, table


def encode_text(text: str, path: str) -> np.ndarray:
    """Ids of one text, encoded in one go."""
    return np.asarray(load(path)[0].encode_to_numpy(text, allowed_special="all"), dtype=np.int32)


def decode_ids(ids, path: str) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD."""
    table = load(path)[1]
    return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


def _spans(ids: list[int], table: list[bytes], start: int) -> list[tuple[int, int, int]]:
    out = []
    for i in ids:
        end = start + len(table[i])
        out.append((start, end, i))
        start = end
    return out


def join(left: np.ndarray, right: np.ndarray, path: str, window: int = WINDOW) -> np.ndarray:
    """The encoding of two neighbouring texts' concatenation from theirs."""
    table = load(path)[1]
    if not len(left) or not len(right):
        return right if not len(left) else left
    inner = lambda i: table[i][:1] and 0x80 <= table[i][0] < 0xC0  # noqa: E731  starts inside a character
    while True:
        a, b = max(0, len(left) - window), min(len(right), window)
        while a > 0 and inner(left[a]):
            a -= 1
        while b < len(right) and inner(right[b]):
            b += 1
        tail, head = left[a:].tolist(), right[:b].tolist()
        raw = b"".join([table[i] for i in tail + head])
        got = encode_text(raw.decode("utf-8"), path)
        mine = _spans(got.tolist(), table, 0)
        seam = sum(len(table[i]) for i in tail)
        at = {s: k for k, s in enumerate(mine)}
        lo = hi = None
        if a == 0:
            lo = (0, 0)  # tokens kept of left, tokens of the window skipped
        else:
            for k, s in enumerate(_spans(tail, table, 0)):
                if s[1] <= seam - MARGIN and s in at:
                    lo = (a + k + 1, at[s] + 1)
                    break
        if b == len(right):
            hi = (len(got), len(right))  # window's tokens kept, tokens of right skipped
        else:
            for k, s in enumerate(_spans(head, table, seam)):
                if s[1] <= len(raw) - MARGIN and s in at:
                    hi = (at[s] + 1, k + 1)
                    break
        if lo and hi and lo[1] <= hi[0]:
            return np.concatenate((left[: lo[0]], got[lo[1]: hi[0]], right[hi[1]:]))
        window *= 2


def join_all(parts: list[np.ndarray], path: str, window: int = WINDOW) -> np.ndarray:
    """Neighbouring encodings joined pairwise, level by level."""
    while len(parts) > 1:
        parts = [join(parts[i], parts[i + 1], path, window) if i + 1 < len(parts) else parts[i]
                 for i in range(0, len(parts), 2)]
    return parts[0] if parts else np.empty(0, np.int32)


def _batch(keys: list, cols: list[np.ndarray], names: list[str], more: list | None = None) -> pa.RecordBatch:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in cols]))).astype(np.int32)
    flat = np.concatenate(cols).astype(np.int32) if cols else np.empty(0, np.int32)
    return pa.RecordBatch.from_arrays([*keys, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), *(more or [])],
                                      names)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
           leaf_chars: int = LEAF_CHARS, window: int = WINDOW, decoded: str | None = None) -> DataFrame:
    """(id, ids): ``ids`` are those that the tokenizers library gives for the
    whole text with ``add_special_tokens=False`` and without truncation or
    padding, special tokens in the text recognised.

    ``decoded`` names a further column, the text of ``ids`` as ``decode`` gives it: decoded
    where the ids are made, so that no second Python worker runs beside the first.

    NULL or empty text: no ids. Texts up to ``leaf_chars`` are encoded where they
    are read. Longer ones are dealt out as leaves over all tasks, and only their
    ids (not the texts) meet again, a document at a time.
    """
    src = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))
    id_type = src.schema["_id"].dataType.simpleString()

    out = ["ids"] if decoded is None else ["ids", "_text"]
    out_type = "ids array<int>" + ("" if decoded is None else ", _text string")

    def texts(coded):
        return [] if decoded is None else [pa.array([decode_ids(x.tolist(), tokenizer) for x in coded], pa.string())]

    def whole(batches):
        for b in slices(batches, 256):
            coded = [encode_text(x, tokenizer) for x in b.column(1).to_pylist()]
            yield _batch([b.column(0)], coded, ["_id", *out], texts(coded))

    short = src.where(F.length("_t") <= leaf_chars).mapInArrow(whole, f"_id {id_type}, {out_type}")

    # rows that agree in id and text are encoded once and counted
    long = (src.where(F.length("_t") > leaf_chars)
            .withColumn("_h", F.sha2("_t", 256)).groupBy("_id", "_h")
            .agg(F.count("*").alias("_n"), F.first("_t").alias("_t")))
    leaves = long.select("_id", "_h", "_n", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.floor((F.length("_t") - 1) / leaf_chars).cast("int")),
        lambda i: F.substring(F.col("_t"), i * leaf_chars + 1, F.lit(leaf_chars)))).alias("_leaf", "_part"))
    leaves = leaves.repartition(partitions(docs.sparkSession), "_id", "_h", "_leaf")

    def leaf(batches):
        for b in slices(batches, 64):
            keys = [b.column(i) for i in range(4)]
            yield _batch(keys, [encode_text(x, tokenizer) for x in b.column(4).to_pylist()],
                         ["_id", "_h", "_n", "_leaf", "ids"])

    coded = leaves.mapInArrow(leaf, f"_id {id_type}, _h string, _n bigint, _leaf int, ids array<int>")

    def tree(batches):
        for b in slices(batches, 1):
            no, ids = b.column(2)[0].values.flatten()
            at = np.argsort(no.to_numpy())
            done = [join_all([ids[int(i)].values.to_numpy() for i in at], tokenizer, window)]
            yield _batch([b.column(0), b.column(1)], done, ["_id", "_n", *out], texts(done))

    whole_long = (coded.groupBy("_id", "_h", "_n").agg(F.collect_list(F.struct("_leaf", "ids")).alias("_parts"))
                  .select("_id", "_n", "_parts")
                  .mapInArrow(tree, f"_id {id_type}, _n bigint, {out_type}")
                  .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select("_id", *out))
    coded = short.unionByName(whole_long)
    names = [id_col, "ids"] if decoded is None else [id_col, "ids", decoded]
    return coded.toDF(*names)


def decode(coded: DataFrame, tokenizer: str, out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col``, the text of ``ids``, special tokens kept; bytes that are
    no UTF-8 become U+FFFD, NULL ids give NULL."""
    from pyspark.sql.types import StringType, StructField, StructType
    schema = StructType([f for f in coded.schema if f.name != out_col] + [StructField(out_col, StringType())])
    names = [f.name for f in schema][:-1]

    def run(batches):
        for b in slices(batches, 256):
            ids = b.column(names.index("ids"))
            # a row's ids at a time: a whole piece of them as Python numbers is many times its size
            text = [decode_ids(x.as_py(), tokenizer) if x.is_valid else None for x in ids]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in range(len(names))), pa.array(text, pa.string())],
                                             [*names, out_col])

    return coded.select(*names).mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, ids_sha256, decoded_sha256): the encoding of each whole
    text and digests of its ids (decimal, comma-joined) and of the text they
    decode to."""
    done = encode(docs, tokenizer, id_col, text_col, decoded="decoded")
    return done.select(
        id_col, F.size("ids").cast("bigint").alias("n_tokens"), "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
