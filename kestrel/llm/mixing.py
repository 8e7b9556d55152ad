"""Mixing sources to target weights, in DataFrame operations only.

Every source's documents are laid end to end, in a pseudorandom order, and cut
into blocks of ``BLOCK`` words. The mix is a number of output shards of ``SHARD``
slots. Each shard draws its slots' sources from the multinomial of the targets;
a source's slots are numbered through all shards, and slot ``q`` holds the block
whose index is ``q`` under the source's pseudorandom permutation of its blocks
(another one each time all blocks are used up). Slots drawn beyond a source's
target stay out and slots it lacks follow in closing shards, so that every
source ends within a block of its target.

Nothing gathers a source in one task: the documents' positions are prefix sums
in two levels (slices of the pseudorandom order, then documents of a slice), and
slots and blocks meet by (source, block index).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checked_broadcast, cut, packed, text_of, unpacked

#: Words of a block.
BLOCK = 64
#: Slots of an output shard.
SHARD = 1024
#: Documents of a slice of a source's order, about.
SLICE = 512
#: The mix has so many words for each word of the input.
SHARE = 1.5
#: A source gives at most so many times its words.
PASSES = 2
#: Weights of the sources by code point, in turn.
WEIGHTS = (3, 1, 2)
#: Primes, the multipliers of the permutations.
PRIMES = (1000000007, 1000000009, 1000000021, 1000000033, 1000000087, 1000000093, 1000000097, 1000000103)
WORD = r"[^\x20\x09-\x0D]+"


def _hash60(*parts) -> Column:
    """60 pseudorandom bits from values as text; NULL counts as empty text."""
    key = F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def source_table(docs: DataFrame, source_col: str = "source", share: float = SHARE, weights=WEIGHTS,
                 passes: int = PASSES, block: int = BLOCK) -> DataFrame:
    """One row per source: sid, source_size, target, blocks, slots and first_slot.

    Targets are ``share`` of all sizes dealt out by weight; where a target is above
    ``passes`` times its source's size it stops there and the excess is dealt out
    to the others by weight, until none is above. With the sources in order of
    limit to weight those that stop come first, so running sums give the level.
    """
    s = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum("size").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * passes)
    order = W.orderBy(F.col("most") / F.col("w"), "sid")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = ((F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0)))
             / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    s = s.withColumn("level", level)
    s = s.withColumn("level", F.max(F.when(F.col("most") > F.col("level") * F.col("w"), F.col("level"))).over(every))
    s = s.withColumn("target", F.coalesce(F.least(F.col("most").cast("double"), F.col("level") * F.col("w")),
                                          F.col("most").cast("double")))
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / block))
    s = s.withColumn("slots", F.when(F.col("target") >= F.col("most"), F.col("blocks") * passes).otherwise(
        F.greatest(F.lit(1), F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5))))
    s = s.withColumn("slots", F.least("slots", F.col("blocks") * passes))
    s = s.withColumn("first_slot", F.sum("slots").over(W.orderBy("sid")) - F.col("slots"))
    return s.select("source", "sid", "source_size", "target", "blocks", "slots", "first_slot")


def draw(sources: DataFrame, slots: int, shard: int = SHARD) -> DataFrame:
    """(shard, sid, n): how many slots of each shard a source gets, a multinomial
    draw with the sources' slots as weights."""
    spark = sources.sparkSession
    cells = 1024
    width = math.ceil(max(1, slots) / cells)
    # the sources' ranges of [0, slots), cut at cell ends: a row each cell and source at most
    ranges = (sources.where("slots > 0")
              .withColumn("cell", F.explode(F.sequence(F.floor(F.col("first_slot") / width),
                                                       F.floor((F.col("first_slot") + F.col("slots") - 1) / width))))
              .select("cell", "sid", "first_slot", (F.col("first_slot") + F.col("slots")).alias("end_slot")))
    drawn = spark.range(slots).select(F.floor(F.col("id") / shard).alias("shard"),
                                      (_hash60(F.lit("draw"), F.col("id")) % max(1, slots)).alias("v"))
    drawn = drawn.withColumn("cell", F.floor(F.col("v") / width))
    return (drawn.join(checked_broadcast(ranges, cells + sources.count()), "cell")
            .where("v >= first_slot and v < end_slot")
            .groupBy("shard", "sid").agg(F.count("*").alias("n")))


def _prefix(df: DataFrame, part: list[str], level: str, order: list, value: str, out: str) -> DataFrame:
    """Adds ``out``, the sum of ``value`` over the rows of the same ``part`` that come
    before by ``level`` and then ``order``: sums of levels first, then rows of a level."""
    sums = df.groupBy(*part, level).agg(F.sum(value).alias("_sum"))
    base = sums.withColumn("_base", F.sum("_sum").over(W.partitionBy(*part).orderBy(level)) - F.col("_sum"))
    own = F.sum(value).over(W.partitionBy(*part, level).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    ranked = df.withColumn("_own", own - F.col(value))
    return (ranked.join(base.drop("_sum"), [*part, level])
            .withColumn(out, F.col("_base") + F.col("_own")).drop("_base", "_own"))


def fill(sources: DataFrame, slots: int, shard: int = SHARD) -> DataFrame:
    """(shard, sid, q, block): the mix, a row for each filled slot."""
    drawn = cut(draw(sources, slots, shard).withColumn("level", F.floor(F.col("shard") / 1024)))
    placed = _prefix(drawn, ["sid"], "level", [F.col("shard")], "n", "before")
    n = sources.count()
    src = checked_broadcast(sources.select("sid", "blocks", F.col("slots").alias("most")), n)
    kept = (placed.join(src, "sid").where("before < most")
            .withColumn("q", F.explode(F.sequence("before", F.least(F.col("before") + F.col("n"), F.col("most")) - 1))))
    lack = (sources.join(drawn.groupBy("sid").agg(F.sum("n").alias("got")), "sid", "left")
            .withColumn("got", F.coalesce("got", F.lit(0))).where("got < slots")
            .withColumn("q", F.explode(F.sequence("got", F.col("slots") - 1)))
            .withColumn("shard", F.lit(math.ceil(slots / shard)) + F.floor((F.col("q") - F.col("got")) / shard)))
    both = kept.select("shard", "sid", "q", "blocks").unionByName(lack.select("shard", "sid", "q", "blocks"))
    turn = F.floor(F.col("q") / F.col("blocks"))
    fit = F.filter(F.array(*map(F.lit, PRIMES)), lambda p: F.col("blocks") % p != 0)
    pick = F.element_at(fit, (_hash60(F.lit("prime"), F.col("sid"), turn) % F.size(fit) + 1).cast("int"))
    step = (pick % F.col("blocks")).cast("decimal(19,0)") * (F.col("q") % F.col("blocks")).cast("decimal(19,0)")
    shift = _hash60(F.lit("shift"), F.col("sid"), turn) % F.col("blocks")
    return both.select("shard", "sid", "q", ((step + shift) % F.col("blocks")).cast("long").alias("block"))


def taken(docs: DataFrame, keys: list[str], id_col: str = "doc_id", source_col: str = "source", share: float = SHARE,
          weights=WEIGHTS, passes: int = PASSES, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """``keys``, size, source_size, target and parts of every row of ``docs`` (which
    has ``size``). parts: (first, words, times) for each piece of the document that
    lies in one block: its first word's number, its words, how often the mix has it."""
    docs = cut(docs)
    sources = cut(source_table(docs, source_col, share, weights, passes, block))
    rows, words = docs.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_sources, slots = sources.agg(F.count("*"), F.coalesce(F.sum("slots"), F.lit(0))).first()
    times = fill(sources, slots, shard).groupBy("sid", "block").agg(F.count("*").alias("times"))
    bits = max(0, math.ceil(math.log2(max(1, rows) / SLICE)))
    src = checked_broadcast(sources.select(F.col("source").alias("_s"), "sid", "source_size", "target"), n_sources)
    d = (docs.join(src, F.col(source_col).eqNullSafe(F.col("_s"))).drop("_s")
         .withColumn("_order", _hash60(F.lit("order"), F.col(id_col)))
         .withColumn("_level", F.shiftright("_order", 60 - bits)))
    tie = [F.col("_order"), *[F.col(k).asc_nulls_first() for k in keys], F.col("size")]
    placed = _prefix(d, ["sid"], "_level", tie, "size", "start")
    placed = cut(placed.select(*keys, "size", "source_size", "target", "sid", "start"))
    pieces = (placed.where("size > 0")
              .withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block),
                                                        F.floor((F.col("start") + F.col("size") - 1) / block))))
              .withColumn("first", F.greatest(F.lit(0), F.col("block") * block - F.col("start")))
              .withColumn("words", F.least(F.col("size"), (F.col("block") + 1) * block - F.col("start")) - F.col("first"))
              .select("sid", "start", "block", "first", "words"))
    parts = (pieces.join(times, ["sid", "block"], "left")
             .groupBy("sid", "start").agg(F.sort_array(F.collect_list(F.struct(
                 "first", "words", F.coalesce("times", F.lit(0)).alias("times")))).alias("parts")))
    return (placed.where("size > 0").join(parts, ["sid", "start"]).drop("sid", "start")
            .unionByName(placed.where("size = 0").drop("sid", "start"), allowMissingColumns=True))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **params) -> DataFrame:
    """(id, size, source_size, target, taken) for every row of ``docs``.

    size: words between ASCII white space, 0 for a NULL text. Sources are ordered by
    code point, NULL (a source like any other) last. taken: words of the document
    that the mix has, repeats counted; 0 for texts without words, and never more
    than ``passes`` times its size. Repeated rows are documents of their own. The
    same rows give the same mix, in whatever order and partitions they come.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                         F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"))
    out = taken(narrow, ["id"], "id", "source", **params)
    return out.select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        F.coalesce(F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["words"] * p["times"]), F.lit(0))
        .cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    **params) -> DataFrame:
    """The mix as documents: for each pass a row of every document that the mix has
    words of, with the words it has (the whole text where it has all), white space
    kept. Documents that the mix leaves out go; texts without words stay as they
    are. Rows that agree in id, source and text get the same words each."""
    src = packed(docs, doc=F.col(id_col), origin=F.col(source_col), body=text_of(text_col),
                 hash=F.xxhash64(text_of(text_col)))
    narrow = src.select(F.col("doc").alias("id"), F.col("origin").alias("source"), F.col("hash").alias("text_hash"),
                        F.regexp_count("body", F.lit(WORD)).cast("long").alias("size")).distinct()
    plan = taken(narrow, ["id", "source", "text_hash"], "id", "source", **params).select(
        "id", "source", "text_hash", F.col("size").alias("n"), "parts")
    out = src.join(plan, F.col("doc").eqNullSafe(F.col("id")) & F.col("origin").eqNullSafe(F.col("source"))
                   & (F.col("hash") == F.col("text_hash")))
    words = F.regexp_extract_all("body", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    passes = params.get("passes", PASSES)
    # the explode keeps Spark from putting the splitting into the lambda below
    out = (out.select("row", "body", "n", "parts", words.alias("words"))
           .withColumn("turn", F.explode(F.when(F.col("n") == 0, F.array(F.lit(0))).otherwise(
               F.sequence(F.lit(0), F.lit(passes - 1)))))
           .withColumn("mine", F.filter("parts", lambda p: p["times"] > F.col("turn")))
           .where("n = 0 or size(mine) > 0"))
    got = F.array_join(F.flatten(F.transform("mine", lambda p: F.slice(
        "words", (p["first"] + 1).cast("int"), p["words"].cast("int")))), "")
    whole = (F.col("n") == 0) | (F.size("mine") == F.size("parts"))
    out = out.withColumn("clean", F.when(whole, F.col("body")).otherwise(got))
    return unpacked(out, docs.columns, **{text_col: F.col("clean")})


def _sql_hash(*parts: str) -> str:
    key = " || '/' || ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)
    return f"CAST('0x' || substr(md5({key}), 1, 15) AS BIGINT)"


#: ``mix`` in DuckDB SQL. What documents give does not depend on which shard holds a
#: slot, so slots are numbered without drawing shards.
SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         {_sql_hash("'order'", "doc_id")} AS ord FROM documents),
s1 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid
       FROM d GROUP BY source),
s2 AS (SELECT *, list_extract({list(WEIGHTS)}, sid % {len(WEIGHTS)} + 1) AS w, source_size * {PASSES} AS most FROM s1),
s3 AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * CAST({SHARE} AS DOUBLE) - coalesce(CAST(sum(most) OVER b AS DOUBLE), 0))
                 / CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS level
       FROM s2 WINDOW b AS (ORDER BY most / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, max(CASE WHEN most > level * w THEN level END) OVER () AS lv FROM s3),
s5 AS (SELECT source, sid, source_size, most, coalesce(least(CAST(most AS DOUBLE), lv * w), CAST(most AS DOUBLE)) AS target,
              (source_size + {BLOCK - 1}) // {BLOCK} AS blocks FROM s4),
s AS (SELECT *, least(blocks * {PASSES}, CASE WHEN target >= most THEN blocks * {PASSES}
        ELSE greatest(1, CAST(floor(target * blocks / source_size + CAST(0.5 AS DOUBLE)) AS BIGINT)) END) AS slots FROM s5),
q AS (SELECT sid, blocks, unnest(range(slots)) AS q FROM s),
p AS (SELECT *, q // blocks AS turn, list_filter({list(PRIMES)}, lambda x: blocks % x <> 0) AS fit FROM q),
t AS (SELECT sid, CAST((CAST(fit[{_sql_hash("'prime'", "sid", "turn")} % len(fit) + 1] % blocks AS HUGEINT) * (q % blocks)
                        + {_sql_hash("'shift'", "sid", "turn")} % blocks) % blocks AS BIGINT) AS block, count(*) AS times
      FROM p GROUP BY ALL),
placed AS (
  SELECT d.doc_id, d.size, s.sid, s.source_size, s.target, row_number() OVER () AS row,
         CAST(sum(d.size) OVER (PARTITION BY s.sid ORDER BY d.ord, d.doc_id NULLS FIRST, d.size
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS start
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
piece AS (SELECT *, unnest(range(start // {BLOCK}, (start + size - 1) // {BLOCK} + 1)) AS block FROM placed WHERE size > 0),
got AS (SELECT row, sum((least(start + size, (p.block + 1) * {BLOCK}) - greatest(start, p.block * {BLOCK})) * t.times) AS taken
        FROM piece p JOIN t ON t.sid = p.sid AND t.block = p.block GROUP BY row)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM placed LEFT JOIN got USING (row)
"""
