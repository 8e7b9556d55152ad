"""Sharding by balanced label propagation, in DataFrame operations only.

Documents of equal texts are linked. Each starts with a pseudorandom shard as its
label, and in each round linked documents want the label that most of their neighbours
have. Documents of one text that have one label are interchangeable, so the rounds work
on pieces, (text, shard, number of documents), never on pairs:

* a piece wants to join its text's largest piece; a text that no shard can hold keeps
  as many homes as its documents need, where most of them are or have room;
* the wishes from shard a to shard b are met up to a quota: as many documents as want to go
  from b to a, plus a share of the room that b has left. So no shard ever grows beyond
  its capacity by a move;
* within a quota wishes are met by falling gain, a piece in part if need be.

Every shard's capacity is the number of documents by shards, rounded down or up. What is over a
capacity after the last round (only random starts can be) fills what lies under others',
and documents without links fill the rest, so that the law ``rows`` holds: any two shards
differ by one document at most.

Orders over a whole quota, group or shard are two-level prefix sums: sums of slices
first, then documents of a slice. With the square root of the rows as the number of
slices, both levels stay small however large one text's group is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checked_broadcast, cut, drop_path, text_of, write_cut

SHARDS = 24
#: Rounds of label propagation, at most.
ROUNDS = 8
#: A document's size is its text's bytes and so many more.
OVERHEAD = 8


def bits60(*parts: Column) -> Column:
    """60 pseudorandom bits: XXH64 (seed 42) of the parts as text, joined by ``/``."""
    return F.shiftrightunsigned(F.xxhash64(F.concat_ws("/", *[p.cast("string") for p in parts])), 4)


def slice_bits(rows: int, parts: int = 1) -> int:
    """Bits of a hash that cut ``rows`` rows of ``parts`` parts into slices as many as a
    slice has rows."""
    return max(0, math.ceil(math.log2(max(1, rows / parts)) / 2))


def before(df: DataFrame, part: list[str], level: str, order: list, value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same ``part`` that come earlier by
    ``level`` and then ``order``."""
    sums = df.groupBy(*part, level).agg(F.sum(value).alias("_sum"))
    base = sums.select(*part, level, (F.sum("_sum").over(W.partitionBy(*part).orderBy(level)) - F.col("_sum")).alias("_base"))
    own = F.sum(value).over(W.partitionBy(*part, level).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return (df.withColumn("_own", own - F.col(value)).join(base, [*part, level])
            .withColumn(out, F.col("_base") + F.col("_own")).drop("_base", "_own"))


def capacity(rows: int, shards: int, shard: str = "shard") -> Column:
    """How many of ``rows`` documents a shard takes."""
    return F.lit(rows // shards) + (F.col(shard) < rows % shards).cast("long")


def first_pieces(rows: DataFrame, shards: int) -> DataFrame:
    """(key, shard, n): documents of each text that occurs more than once, by their first label."""
    pieces = rows.groupBy("key", (F.col("order") % shards).cast("int").alias("shard")).agg(F.count("*").alias("n"))
    linked = pieces.groupBy("key").agg(F.sum("n").alias("m")).where("m > 1").drop("m")
    return pieces.join(linked, "key")


def wishes(pieces: DataFrame, rows: int, shards: int, turn: int) -> DataFrame:
    """(key, source, goal, n, gain): pieces that want to join another one of their text.
    gain: documents of the text at the goal less those at the source, and one.

    A text that fits into a shard has its largest piece as its home, or the largest in a
    shard with room for the rest where there is one. A larger text's homes are the pieces with the most documents
    and room, as many as hold it all; the others want to go to those that have room."""
    load = pieces.groupBy("shard").agg(F.sum("n").alias("load"))
    room = load.select("shard", F.greatest(F.lit(0), capacity(rows, shards) - F.col("load")).alias("room"))
    tie = bits60(F.lit("tie"), F.lit(turn), F.col("key"), F.col("shard"))
    # a row for each shard: the table's size is bounded by their number
    held = pieces.join(checked_broadcast(room, shards), "shard").withColumn("tie", tie)
    groups = held.groupBy("key").agg(F.sum("n").alias("m"), F.collect_list(F.struct("n", "tie", "shard", "room")).alias("held"))
    fits = F.col("m") <= -(-rows // shards)
    order = lambda lacks, worth: lambda p: F.struct(
        lacks(p).alias("lacks"), (-worth(p)).alias("less"), p["tie"].alias("tie"), p["shard"].alias("shard"),
        p["n"].alias("n"), p["room"].alias("room"))
    small = F.transform("held", order(lambda p: p["room"] < F.col("m") - p["n"], lambda p: p["n"]))
    large = F.transform("held", order(lambda p: F.lit(False), lambda p: p["n"] + p["room"]))
    groups = groups.select("key", "m", fits.alias("fits"), F.sort_array(F.when(fits, small).otherwise(large)).alias("held"))
    enough = F.reduce("held", F.struct(F.lit(0).cast("long").alias("got"), F.lit(0).alias("homes")), lambda a, p: F.when(
        a["got"] < F.col("m"), F.struct((a["got"] - p["less"]).alias("got"), (a["homes"] + 1).alias("homes"))).otherwise(a))
    groups = groups.withColumn("homes", F.when(F.col("fits"), F.lit(1)).otherwise(enough["homes"]))
    groups = groups.withColumn("goals", F.when(F.col("fits"), F.slice("held", 1, 1)).otherwise(
        F.filter(F.slice("held", F.lit(1), F.col("homes")), lambda p: p["room"] > 0)))
    each = (groups.where("size(goals) > 0").select("key", "homes", "goals", F.posexplode("held").alias("no", "piece"))
            .where("no >= homes").withColumn("to", F.expr("goals[(no - homes) % size(goals)]")))
    return each.select("key", F.col("piece.shard").alias("source"), F.col("piece.n").alias("n"),
                       F.col("to.shard").alias("goal"), F.greatest(F.lit(1), F.col("to.n") - F.col("piece.n") + 1).alias("gain"))


def quotas(wanted: DataFrame, pieces: DataFrame, rows: int, shards: int, turn: int) -> DataFrame:
    """(source, goal, quota): how many documents may go from one shard to another."""
    flow = wanted.groupBy("source", "goal").agg(F.sum("n").alias("w"))
    back = flow.select(F.col("source").alias("goal"), F.col("goal").alias("source"), F.col("w").alias("back"))
    load = pieces.groupBy(F.col("shard").alias("goal")).agg(F.sum("n").alias("load"))
    q = (flow.join(back, ["source", "goal"], "left").join(load, "goal")
         .withColumn("even", F.least("w", F.coalesce("back", F.lit(0)))))
    q = q.withColumn("more", F.col("w") - F.col("even"))
    every = W.partitionBy("goal")
    q = q.withColumn("total", F.sum("more").over(every))
    q = q.withColumn("room", F.least("total", F.greatest(F.lit(0), capacity(rows, shards, "goal") - F.col("load"))))
    # shares are rounded by running sums, so that they add up to the room
    turned = bits60(F.lit("room"), F.lit(turn), F.col("source"))
    q = q.withColumn("upto", F.sum("more").over(every.orderBy(turned, "source").rowsBetween(W.unboundedPreceding, 0)))
    # decimals: products of two counts may not fit a long
    part = "cast(room as decimal(19,0)) * cast({} as decimal(19,0)) div nullif(total, 0)".format
    share = F.expr(part("upto")) - F.expr(part("upto - more"))
    return q.select("source", "goal", (F.col("even") + F.coalesce(share, F.lit(0))).alias("quota"))


def moves(pieces: DataFrame, rows: int, shards: int, turn: int) -> DataFrame:
    """(key, source, goal, k): the moves of one round, k documents of a text each."""
    wanted = cut(wishes(pieces, rows, shards, turn))
    n = wanted.count()
    quota = quotas(wanted, pieces, rows, shards, turn)
    bits = slice_bits(n, shards * shards)
    w = wanted.withColumn("hash", bits60(F.lit("move"), F.col("key"), F.col("source")))
    rank = F.lit(64) - F.length(F.bin("gain"))
    w = w.withColumn("level", rank * (1 << bits) + F.shiftright("hash", 60 - bits))
    placed = before(w, ["source", "goal"], "level", [F.col("hash"), F.col("key")], "n", "ahead")
    # a row for each pair of shards at most
    out = placed.join(checked_broadcast(quota, shards * shards), ["source", "goal"])
    return (out.withColumn("k", F.least("n", F.col("quota") - F.col("ahead"))).where("k > 0")
            .select("key", "source", "goal", "k"))


def propagate(pieces: DataFrame, rows: int, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """Pieces after label propagation; rounds end when nothing moves. Each round is
    written to the shared folder."""
    pieces, path = write_cut(pieces)
    for turn in range(rounds):
        moved = cut(moves(pieces, rows, shards, turn))
        if moved.isEmpty():
            break
        change = moved.select("key", F.col("source").alias("shard"), (-F.col("k")).alias("n")).unionByName(
            moved.select("key", F.col("goal").alias("shard"), F.col("k").alias("n")))
        after = pieces.unionByName(change).groupBy("key", "shard").agg(F.sum("n").alias("n")).where("n > 0")
        after, new_path = write_cut(after)
        drop_path(pieces.sparkSession, path)
        pieces, path = after, new_path
    return pieces


def _loads(pieces: DataFrame, shards: int) -> list[int]:
    load = dict(pieces.groupBy("shard").agg(F.sum("n")).collect())  # a number for each shard
    return [load.get(s, 0) for s in range(shards)]


def _spans(room: list[int]) -> Column:
    """(shard, start, stop) of each shard with room, its share of 0, 1, 2..."""
    out, at = [], 0
    for s, r in enumerate(room):
        if r:
            out.append(F.struct(F.lit(s).alias("shard"), F.lit(at).cast("long").alias("start"),
                                F.lit(at + r).cast("long").alias("stop")))
        at += r
    kind = "array<struct<shard:int,start:bigint,stop:bigint>>"
    return F.array(*out).cast(kind) if out else F.array().cast(kind)


def settle(pieces: DataFrame, rows: int, shards: int) -> DataFrame:
    """Pieces of which no shard has more than its capacity: the last of a shard that has
    go where others have room."""
    load = _loads(pieces, shards)
    most = [rows // shards + (s < rows % shards) for s in range(shards)]
    if all(a <= b for a, b in zip(load, most)):
        return pieces
    over = [max(0, a - b) for a, b in zip(load, most)]
    room = [max(0, b - a) for a, b in zip(load, most)]
    bits = slice_bits(pieces.count(), shards)
    p = pieces.withColumn("hash", bits60(F.lit("stay"), F.col("key"), F.col("shard")))
    p = p.withColumn("level", (F.lit(64) - F.length(F.bin("n"))) * (1 << bits) + F.shiftright("hash", 60 - bits))
    p = before(p, ["shard"], "level", [F.col("hash"), F.col("key")], "n", "ahead")
    p = p.withColumn("stay", F.greatest(F.lit(0), F.least("n", capacity(rows, shards) - F.col("ahead"))))
    p = cut(p)
    first = F.element_at(F.array(*[F.lit(sum(over[:s])).cast("long") for s in range(shards)]), F.col("shard") + 1)
    out = (p.where("stay < n")
           .withColumn("a", first + F.greatest(F.lit(0), F.col("ahead") - capacity(rows, shards)))
           .withColumn("b", F.col("a") + F.col("n") - F.col("stay"))
           .withColumn("span", F.explode(_spans(room)))
           .select("key", F.col("span.shard").alias("shard"),
                   (F.least("b", "span.stop") - F.greatest("a", "span.start")).alias("n")).where("n > 0"))
    return (p.where("stay > 0").select("key", "shard", F.col("stay").alias("n")).unionByName(out)
            .groupBy("key", "shard").agg(F.sum("n").alias("n")))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
          rounds: int = ROUNDS) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``.

    size: the text's UTF-8 bytes and ``OVERHEAD``; a NULL text counts as empty and is linked
    with empty ones. law: ``rows``, shards differ by one row at most. slot: 0, 1, 2... within
    the shard, in a pseudorandom order of ids (NULL as an empty one). grown_shard: NULL, as
    another number of shards deals all rows anew. Repeated rows are documents of their
    own; rows that agree in id and text get their places in any order. Fewer rows than
    shards leave shards empty. The same rows give the same shards, in whatever order and
    partitions they come; other columns are not read.
    """
    body = text_of(text_col).cast("binary")
    rows = cut(docs.select(F.col(id_col).alias("id"), (F.octet_length(text_of(text_col)) + OVERHEAD).cast("long").alias("size"),
                           F.crc32(body).alias("text_crc32"), F.md5(body).alias("key"))
               .withColumn("order", bits60(F.lit("order"), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    n = rows.count()
    pieces = cut(settle(propagate(first_pieces(rows, shards), n, shards, rounds), n, shards))
    rest = [n // shards + (s < n % shards) - a for s, a in enumerate(_loads(pieces, shards))]
    start = F.sum("n").over(W.partitionBy("key").orderBy("shard")) - F.col("n")  # a row a shard at most
    spans = (pieces.select("key", F.struct("shard", start.alias("start"), (start + F.col("n")).alias("stop")).alias("span"))
             .groupBy("key").agg(F.collect_list("span").alias("spans")))
    # a join alone, so that Spark can split a text that very many documents have
    tagged = cut(rows.join(spans, "key", "left"))
    tie = [F.col(c) for c in ("order", "id", "size", "text_crc32", "key")]
    level = F.shiftright("order", 60 - slice_bits(n))
    whole = tagged.where("size(spans) = 1").withColumn("shard", F.expr("spans[0].shard"))
    # documents without links count as one text whose pieces are the room left
    parted = (tagged.where("spans is null or size(spans) > 1")
              .withColumn("text", F.when(F.col("spans").isNull(), F.lit("")).otherwise(F.col("key")))
              .withColumn("level", level).withColumn("one", F.lit(1).cast("long")))
    parted = before(parted, ["text"], "level", tie, "one", "at")
    mine = F.filter(F.coalesce("spans", _spans(rest)), lambda s: (s["start"] <= F.col("at")) & (F.col("at") < s["stop"]))
    cols = ["id", "size", "text_crc32", "key", "order", "shard"]
    placed = cut(whole.select(*cols).unionByName(parted.withColumn("shard", mine[0]["shard"]).select(*cols)))
    # another hash than the one that dealt out the shards, so that slices are even within each
    placed = placed.withColumn("turn", bits60(F.lit("slot"), F.col("order")))
    placed = placed.withColumn("level", F.shiftright("turn", 60 - slice_bits(n, shards))).withColumn("one", F.lit(1).cast("long"))
    out = before(placed, ["shard"], "level", [F.col("turn"), *tie], "one", "slot")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
