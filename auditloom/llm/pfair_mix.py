"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

A source with the whole-number weight k of a period P (the sum of all weights) has a share of k / P of the slots. Its
block j (from 0) is released at floor(j * P / k) and is due by ceil((j + 1) * P / k). Earliest deadline first over the
released blocks fills every slot of the period, and at every moment each source has received its share to within less
than one block. The pattern of one period repeats, so block j of a source stands at slot
P * (j div k) + pattern(source, j mod k).

Every document is placed, none is dropped or repeated: ``slot`` orders the blocks of the mix, ``place`` the documents in
a block. ``exact`` marks the slots before the first one that a source can't fill; up to there the shares hold, after it the sources
that are left keep their own slots.

Documents are numbered within a source without gathering a source anywhere: they are dealt to bundles by the hash of their id, a small table of
counts gives each bundle's offset, and rows are numbered inside a bundle.

Defined cases: a null source is a source of its own; a source without a target weight gets weight 1; weights below 1
count as 1; documents are numbered by (bundle, id, text), so repeated rows take places one after the other; an empty table gives an empty
result; the number of sources and the sum of weights bound the pattern and what is broadcast, not the documents; extra columns are kept, but for the columns named in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bundle(doc_id: str) -> Column:
    """The bundle of a document: the first 16 bits of its id's md5, 65,536 at any size; each source has one offset for each."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 1, 4), 16, 10).cast("int")


def default_weights(counts: DataFrame, power: float = 0.5, period: int = 200) -> DataFrame:
    """(key, weight): whole-number weights in proportion to count ** power, at least 1."""
    whole = counts.agg(F.sum(F.pow("n", F.lit(power))).alias("whole"))
    return counts.crossJoin(F.broadcast(whole)).select("key", F.greatest(F.lit(1), F.round(F.pow("n", F.lit(power)) / F.col("whole") * period)).cast("int").alias("weight"))


def pattern(weights: DataFrame) -> DataFrame:
    """(key, weight, period, turn, slot): the slots of one period, by earliest deadline first; one row of ``weights`` a source."""
    one = weights.agg(F.array_sort(F.collect_list(F.struct("key", "weight"))).alias("s"))  # one entry a source
    one = one.select("s", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["weight"]).alias("p"))

    def due(s: Column, done: Column, t: Column, p: Column) -> Column:
        """(deadline, source) of the released block of the earliest deadline."""
        each = F.transform(
            s, lambda x, i: F.when(F.floor(F.element_at(done, (i + 1).cast("int")) * p / x["weight"]) <= t, F.struct(F.ceil((F.element_at(done, (i + 1).cast("int")) + 1) * p / x["weight"]).alias("d"), i.cast("int").alias("i")))
        )
        return F.array_min(F.filter(each, lambda x: x.isNotNull()))

    start = F.struct(F.transform("s", lambda x: F.lit(0).cast("long")).alias("done"), F.array().cast("array<struct<i:int,turn:bigint>>").alias("picks"))

    def merge(state: Column, t: Column) -> Column:
        pick = due(F.col("s"), state["done"], t, F.col("p"))["i"]
        turn = F.element_at(state["done"], (pick + 1).cast("int"))
        return F.struct(F.transform(state["done"], lambda c, i: F.when(i == pick, c + 1).otherwise(c)).alias("done"), F.concat(state["picks"], F.array(F.struct(pick.alias("i"), turn.alias("turn")))).alias("picks"))

    run = one.where(F.size("s") > 0).select("s", "p", F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("p") - 1), start, merge).alias("r"))
    flat = run.select("s", "p", F.posexplode("r.picks").alias("slot", "x"))
    mine = F.element_at("s", (F.col("x.i") + 1).cast("int"))
    return flat.select(mine["key"].alias("key"), mine["weight"].alias("weight"), F.col("p").alias("period"), F.col("x.turn").alias("turn"), F.col("slot").cast("long").alias("slot"))


def mix(docs: DataFrame, weights: DataFrame | None = None, block: int = 16, doc_id: str = "doc_id", source: str = "source", text: str = "text", power: float = 0.5) -> DataFrame:
    """All rows of ``docs`` with block, release, deadline, slot, place and exact. ``weights``: (source, weight), or in proportion to count ** power."""
    key = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))
    rows = docs.drop("block", "release", "deadline", "slot", "place", "exact", "_key", "_bundle")
    counts = rows.groupBy(key.alias("key"), _bundle(doc_id).alias("h")).agg(F.count("*").alias("n"))
    sizes = counts.groupBy("key").agg(F.sum("n").alias("n"))
    if weights is None:
        weights = default_weights(sizes, power)
    else:
        given = weights.groupBy(F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("key")).agg(F.max("weight").alias("weight"))
        weights = sizes.join(given, "key", "left").select("key", F.greatest(F.lit(1), F.coalesce(F.col("weight").cast("int"), F.lit(1))).alias("weight"))
    turns = pattern(weights)
    before = F.sum("n").over(Window.partitionBy("key").orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("key", "h", "n", F.coalesce(before, F.lit(0)).alias("offset"))
    number = F.row_number().over(Window.partitionBy("_key", "_bundle").orderBy(F.col(doc_id), F.col(text)))
    numbered = rows.withColumn("_key", key).withColumn("_bundle", _bundle(doc_id)).withColumn("_n", number - 1)
    numbered = numbered.join(offsets.select(F.col("key").alias("_key"), F.col("h").alias("_bundle"), "offset"), ["_key", "_bundle"]).withColumn("_n", F.col("_n") + F.col("offset")).drop("offset")
    numbered = numbered.withColumn("_block", F.expr(f"_n div {block}")).withColumn("place", F.expr(f"int(_n % {block})"))
    info = turns.groupBy("key").agg(F.max("weight").alias("weight"), F.max("period").alias("period"), F.collect_list(F.struct("turn", "slot")).alias("t"))
    info = info.join(sizes, "key").select(F.col("key").alias("_key"), "weight", "period", F.transform(F.array_sort("t"), lambda x: x["slot"]).alias("slots"), F.expr(f"(n + {block - 1}) div {block}").alias("blocks"))
    first_lack = F.col("period") * F.expr("blocks div weight") + F.element_at("slots", (F.expr("blocks % weight") + 1).cast("int"))
    info = info.withColumn("lack", first_lack)
    full = info.agg(F.min("lack").alias("full"))
    out = numbered.join(F.broadcast(info.drop("lack", "blocks")), "_key").join(F.broadcast(full))
    out = out.withColumn("slot", F.expr("period * (_block div weight)") + F.element_at("slots", (F.expr("_block % weight") + 1).cast("int")))
    out = out.withColumn("release", F.floor(F.col("_block") * F.col("period") / F.col("weight"))).withColumn("deadline", F.ceil((F.col("_block") + 1) * F.col("period") / F.col("weight")))
    return out.withColumn("exact", F.col("slot") < F.col("full")).select(*rows.columns, F.col("_block").alias("block"), "release", "deadline", "slot", "place", "exact")
