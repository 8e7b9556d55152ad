"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are laid out in tiles by population counts, those of the
four 16-bit words of a fingerprint. Flipping one bit changes one of the counts by
one, so fingerprints within the radius lie in tiles whose counts differ by the
radius in sum at most; other pairs of tiles are never compared. Within a pair of
tiles every fingerprint of the one is compared with every one of the other, with
numpy's exclusive-or and bit counts, so no link is lost.

A tile with many fingerprints is split into blocks of about ``BLOCK``, and each
pair of blocks is a group of its own, so a crowded tile is spread over tasks. A
group gives its links as a spanning forest, of fewer rows than it has
fingerprints, however many pairs match.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, cut, packed, shingle_hashes, slices, text_of, unpacked
from .graph import components, local_forest

#: Fingerprints of a tile that make a block; a group compares a block with one
#: block of each neighbouring tile.
BLOCK = 2048
WORDS = 4


def fingerprint(text: str, shingle: int = 3) -> int:
    """64 bits: a bit is 1 if more than half of the hashes of the text's shingles
    have it; a text without words has 0."""
    h = shingle_hashes(ascii_words(text, lower=True), shingle)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i:i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, text_hash, fp): the fingerprint as a signed long with the same bits;
    ``text_hash`` tells rows with one id and different texts apart."""
    src = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    id_type = src.schema["id"].dataType.simpleString()

    def run(batches):
        for b in slices(batches, 512):
            fp = np.array([fingerprint(x, shingle) for x in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["id", "text_hash", "fp"])

    return src.select("id", F.xxhash64("t").alias("text_hash"), "t").mapInArrow(
        run, f"id {id_type}, text_hash bigint, fp bigint")


def _tile(fp: Column) -> Column:
    """Population counts of the words of ``fp``, as digits to the base 17."""
    out = F.lit(0)
    for w in range(WORDS):
        out = out * 17 + F.bit_count(F.shiftrightunsigned(fp, 16 * w).bitwiseAND(F.lit(0xFFFF)))
    return out.cast("int")


def _moves(radius: int) -> list[list[int]]:
    """Count differences of ``radius`` in sum at most, one of each pair d and -d."""
    every = itertools.product(range(-radius, radius + 1), repeat=WORDS)
    return [list(d) for d in every if sum(map(abs, d)) <= radius and d <= (0,) * WORDS]


def compare(base: np.ndarray, probe: np.ndarray, radius: int, chunk: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links between two arrays of fingerprints (signed longs)."""
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    x, y = base.view(np.uint64), probe.view(np.uint64)
    for i in range(0, len(x), chunk):
        for j in range(0, len(y), chunk):
            near = np.bitwise_count(x[i:i + chunk, None] ^ y[None, j:j + chunk]) <= radius
            r, c = np.nonzero(near)
            if len(r):
                p, q = base[i + r], probe[j + c]
                away = p != q
                if away.any():
                    node, root = local_forest(p[away], q[away])
                    a.append(node)
                    b.append(root)
    a, b = np.concatenate(a), np.concatenate(b)
    return local_forest(a, b) if len(a) else (a, b)


def links(fps: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """(a, b): links whose components are those of all pairs of the distinct
    values of ``fps.fp`` that differ in ``radius`` bits at most."""
    reps = fps.select("fp").distinct().withColumn("tile", _tile(F.col("fp")))
    # at most 17**4 rows: a proven bound
    sizes = reps.groupBy("tile").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sizes = cut(sizes)
    reps = (reps.join(F.broadcast(sizes), "tile")
            .withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")))
    digits = [F.floor(F.col("tile") / 17 ** (WORDS - 1 - w)) % 17 for w in range(WORDS)]
    moved = reps.withColumn("move", F.explode(F.array(*[F.array(*map(F.lit, d)) for d in _moves(radius)])))
    near = [digits[w] + F.col("move")[w] for w in range(WORDS)]
    inside = F.lit(True)
    to = F.lit(0)
    for x in near:
        inside = inside & (x >= 0) & (x <= 16)
        to = to * 17 + x
    bases = sizes.select(F.col("tile").alias("base"), F.col("blocks").alias("base_blocks"))
    probes = (moved.where(inside).withColumn("base", to.cast("int")).join(F.broadcast(bases), "base")
              .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("base_blocks") - 1)))
              .where("base != tile or i <= block")
              .select("base", "i", F.col("block").alias("j"), F.lit(None).cast("long").alias("x"), F.col("fp").alias("y")))
    # a base block meets every block number that a neighbour has
    widest = probes.groupBy("base").agg(F.max("j").alias("last"))
    own = (reps.join(F.broadcast(widest), reps.tile == widest.base)
           .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("last"))))
           .select("base", F.col("block").alias("i"), "j", F.col("fp").alias("x"), F.lit(None).cast("long").alias("y")))
    groups = (probes.unionByName(own).groupBy("base", "i", "j")
              .agg(F.collect_list("x").alias("x"), F.collect_list("y").alias("y"))
              .where("size(x) > 0 and size(y) > 0").select("x", "y"))

    def run(batches):
        for b in slices(batches, 64):
            a, z = [], []
            for x, y in zip(b.column(0), b.column(1)):
                node, root = compare(x.values.to_numpy(), y.values.to_numpy(), radius)
                a.append(node)
                z.append(root)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(z))], ["a", "b"])

    return groups.mapInArrow(run, "a bigint, b bigint")


def component_table(fps: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """(fp, first): for every distinct fingerprint the smallest (id, text_hash)
    of its component, NULL ids last."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("first")
    reps = cut(fps.groupBy("fp").agg(first))
    roots = components(links(reps, radius, block))
    rooted = (reps.join(roots, reps.fp == roots.node, "left")
              .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    best = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return cut(rooted.select("fp", "root").join(best, "root").select("fp", "first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    radius: int = 2, block: int = BLOCK) -> DataFrame:
    """(id, fingerprint, component_id) for every row.

    Texts are lower-cased (A-Z), split at ASCII white space and shingled by
    ``shingle`` words; texts without words have fingerprint zero and link like any
    other. Fingerprints link at ``radius`` or fewer differing bits. component_id is
    the smallest id reachable by links, itself included; NULL only if every id of
    the component is NULL.
    """
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    first = component_table(fps, radius, block)
    return (fps.join(first, "fp")
            .select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                    F.col("first.id").alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
             radius: int = 2, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id (NULL ids
    last, then by the text's hash). Repeated rows are copies of each other, so one
    of them stays."""
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    first = component_table(fps, radius, block).select("first.*").distinct()
    src = packed(docs, doc=F.col(id_col), hash=F.xxhash64(text_of(text_col)))
    out = src.join(first, F.col("doc").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("text_hash")), "left_semi")
    rows, distinct = fps.agg(F.count("*"), F.count_distinct(F.struct("id", "text_hash"))).first()
    if rows > distinct:
        out = out.dropDuplicates(["doc", "hash"])
    return unpacked(out, docs.columns)
