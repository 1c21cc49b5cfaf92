"""Mixing sources to target weights by pivotal dependent rounding.

A source's target words over its words is each of its documents' rate: the whole part is copied outright, the
fractional part is rounded. Rounding pairs two documents and moves probability mass, weighted by their words, from one
to the other until one of them is 0 or 1; the other goes on to the next pair. So a source's expected words never change,
and what is left at the end is one document. Blocks of about BLOCK documents are folded side by side, each passes one
remainder up, and FAN remainders are folded at each level of the tree above: no group grows with a source.

Everything is DataFrame functions on the JVM. The coin of each pair is a hash, so reruns agree.

Edge cases: a null text has size 0 and is never taken; a null source is a source of its own, last in order; rows that
repeat (document, source and text alike) are rounded as one unit that stands for all of them; a source without words
has target 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_count

WEIGHTS, CAP, BLOCK, FAN, SEED = (5.0, 2.0, 1.0), 3.0, 48, 48, 42
#: The table of sources is broadcast up to so many rows, and joined by shuffle beyond.
BROADCAST_SOURCES = 100_000


def _weighted(sums: DataFrame) -> DataFrame:
    """Adds w: sources in order take the weights in turn. They are sorted in ranges, so a source's place is its place in
    its range and the sizes of the ranges before, of which the driver gets one number each."""
    order = F.col("source").asc_nulls_last()
    ranged = sums.repartitionByRange(order).sortWithinPartitions(order).withColumn("__at", F.monotonically_increasing_id())
    ranged = materialize(ranged.withColumns({"__range": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND((1 << 33) - 1)}), "mix-sources")
    sizes = sorted(tuple(r) for r in ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect())
    before = F.create_map(*[F.lit(x) for i, (r, _) in enumerate(sizes) for x in (int(r), sum(n for _, n in sizes[:i]))]) if sizes else F.create_map().cast("map<bigint,int>")
    place = ((F.col("__at") + F.element_at(before, F.col("__range").cast("int" if sizes else "bigint"))) % len(WEIGHTS)).cast("int")
    return ranged.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), place + 1)).drop("__at", "__range")


def source_targets(units: DataFrame) -> DataFrame:
    """(source, source_size, target, n_units), one row per source.

    Water filling: a source is capped if its cap is below its weight times the level; what that leaves goes to the others
    and raises the level, until no further source is capped. Each round is one aggregate over the sources.
    """
    sums = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("n_units"))
    w = materialize(_weighted(sums).withColumn("cap", CAP * F.col("source_size")), "mix-weights")
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") / F.col("w") <= level
        got = w.agg(F.sum("source_size").cast("double"), F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w"))), F.count_if(full)).first()
        if got[3] == capped or not got[2]:
            break
        level, capped = (got[0] - got[1]) / got[2], got[3]
    return w.select("source", "source_size", F.least(F.col("w") * level, F.col("cap")).cast("double").alias("target"), "n_units")


_UNIT = "struct<id:struct<doc_id:bigint,th:bigint>,size:bigint,m:bigint,whole:bigint,x:double>"
#: One step of the fold. s: (out: decided units, c: the unit in hand). t: the next unit, u its coin.
_PIVOT = """
aggregate(units, named_struct('out', cast(array() as array<{u}>), 'c', cast(null as {u})), (s, t) ->
  case
    when s.c is null then named_struct('out', s.out, 'c', t.v)
    when s.c.x <= 0 or s.c.x >= 1 then named_struct('out', concat(s.out, array(s.c)), 'c', t.v)
    when t.v.x <= 0 or t.v.x >= 1 then named_struct('out', concat(s.out, array(t.v)), 'c', s.c)
    else transform(array(named_struct('c', s.c, 't', t.v, 'q', t.v.size / s.c.size,
           'up', least(1 - s.c.x, t.v.size * t.v.x / s.c.size), 'down', least(s.c.x, t.v.size * (1 - t.v.x) / s.c.size))), p ->
         transform(array(case when t.u * (p.up + p.down) < p.down
             then named_struct('c', case when 1 - p.c.x <= p.q * p.t.x then 1D else p.c.x + p.up end,
                               't', case when 1 - p.c.x < p.q * p.t.x then p.t.x - p.up / p.q else 0D end)
             else named_struct('c', case when p.c.x <= p.q * (1 - p.t.x) then 0D else p.c.x - p.down end,
                               't', case when p.c.x < p.q * (1 - p.t.x) then p.t.x + p.down / p.q else 1D end) end), x ->
           case when x.c <= 0 or x.c >= 1
             then named_struct('out', concat(s.out, array(named_struct('id', p.c.id, 'size', p.c.size, 'm', p.c.m, 'whole', p.c.whole, 'x', x.c))),
                               'c', named_struct('id', p.t.id, 'size', p.t.size, 'm', p.t.m, 'whole', p.t.whole, 'x', x.t))
             else named_struct('out', concat(s.out, array(named_struct('id', p.t.id, 'size', p.t.size, 'm', p.t.m, 'whole', p.t.whole, 'x', x.t))),
                               'c', named_struct('id', p.c.id, 'size', p.c.size, 'm', p.c.m, 'whole', p.c.whole, 'x', x.c)) end)[0])[0]
  end)""".replace("{u}", _UNIT)


def _fold(rows: DataFrame, level: int) -> DataFrame:
    """(source, block, v) -> (source, block, out, c): one fold per block, in the order of a hash."""
    coin = F.pmod(F.xxhash64("v.id.doc_id", "v.id.th", F.lit(SEED + level)), F.lit(1 << 30)) / float(1 << 30)
    order = F.xxhash64("v.id.doc_id", "v.id.th", F.lit(-1 - level))
    held = rows.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "v", coin.alias("u")))).alias("units"))
    return held.select("source", "block", F.expr(_PIVOT).alias("f")).select("source", "block", "f.out", "f.c")


def decide(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions, targets). A decision: source, doc_id, th (the text's hash), size, m rows, and copies of all of them.
    The targets are marked for broadcast if they are few enough."""
    size = F.when(F.col("text").isNull(), F.lit(0)).otherwise(word_count("text")).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("th"), size.alias("size"))
    units = materialize(rows.groupBy("source", "doc_id", "th", "size").agg(F.count(F.lit(1)).alias("m")), "mix-units")
    targets = materialize(source_targets(units), "mix-targets")
    known = targets.agg(F.count(F.lit(1)), F.max("n_units")).first()
    small = F.broadcast if known[0] <= BROADCAST_SOURCES else lambda df: df
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    rated = units.join(small(targets), units["source"].eqNullSafe(targets["source"])).select(units["source"], "doc_id", "th", "size", "m", "n_units", rate.alias("rate"))
    part = rated.withColumn("base", F.floor("rate")).withColumn("frac", F.col("m") * (F.col("rate") - F.floor("rate")))
    # of m rows alike, pairing settles all but one among themselves
    unit = F.struct(F.struct("doc_id", "th").alias("id"), "size", "m", (F.col("m") * F.col("base") + F.floor("frac")).cast("long").alias("whole"), (F.col("frac") - F.floor("frac")).alias("x"))
    blocks = F.ceil(F.col("n_units") / BLOCK)
    first = part.filter("size > 0").select("source", F.pmod(F.xxhash64("doc_id", "th", F.lit(SEED)), blocks).alias("block"), unit.cast(_UNIT).alias("v"))
    level, most, done = 0, math.ceil((known[1] or 0) / BLOCK), []
    folded = materialize(_fold(first, level), "mix-0")
    while most > 1:
        done.append(folded.select("source", F.explode("out").alias("v")))
        level, most = level + 1, math.ceil(most / FAN)
        up = folded.filter("c is not null").select("source", F.floor(F.col("block") / FAN).alias("block"), F.col("c").alias("v"))
        folded = materialize(_fold(up, level), f"mix-{level}")
    done.append(folded.select("source", F.explode("out").alias("v")))
    last = F.pmod(F.xxhash64("c.id.doc_id", "c.id.th", F.lit(SEED - 1)), F.lit(1 << 30)) / float(1 << 30)
    done.append(folded.filter("c is not null").select("source", F.col("c").withField("x", F.when(last < F.col("c.x"), 1.0).otherwise(0.0)).alias("v")))
    rounded = done[0]
    for more in done[1:]:
        rounded = rounded.unionAll(more)
    copies = (F.col("v.whole") + F.when(F.col("v.x") >= 1, 1).otherwise(0)).cast("long")
    out = rounded.select("source", "v.id.doc_id", "v.id.th", "v.size", "v.m", copies.alias("copies"))
    nothing = units.filter("size = 0").select("source", "doc_id", "th", "size", "m", F.lit(0).cast("long").alias("copies"))
    return out.unionAll(nothing), small(targets)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row per document."""
    out, targets = decide(docs)
    rows = out.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    each = F.floor(F.col("copies") / F.col("m")) + F.when(F.col("i") <= F.col("copies") % F.col("m"), 1).otherwise(0)
    return rows.join(targets, rows["source"].eqNullSafe(targets["source"])).select("doc_id", rows["source"], "size", "source_size", "target", (each * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The documents themselves, each row as often as the mix takes it. Of rows that repeat, one stands for all."""
    out, _ = decide(docs)
    repeated = out.filter("m > 1").limit(1).count()
    keyed = docs.withColumn("__th", F.xxhash64("text"))
    keyed = keyed.dropDuplicates(["doc_id", "source", "__th"]) if repeated else keyed
    take = out.filter("copies > 0").select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("th").alias("__t"), "copies").withColumnRenamed("copies", "__copies")
    same = keyed["doc_id"].cast("long").eqNullSafe(take["__id"]) & keyed["source"].cast("string").eqNullSafe(take["__source"]) & (keyed["__th"] == take["__t"])
    return keyed.join(take, same).withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)
