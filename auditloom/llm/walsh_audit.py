"""Audit of how filters interact, by Walsh-Hadamard transform of their failure masks.

Five filters judge every document; bit k of a document's mask says that it fails filter k. In whatever order the filters
run, what each removes depends on how many documents have each of the 32 masks, in each part and under each label:

1. A document's mask and the SHA-256 of its text leave the scan; the text itself is never shuffled. Equal rows merge.
2. The fifth filter looks at the whole table: a document fails where a smaller id has the same text. The rows of a
   digest are merged by part and labels first, with the least id and how often it occurs, so a text that a third of all
   documents hold is a handful of rows when the least id of the whole table meets them.
3. One aggregate keeps 32 signed sums for each part and label: sum number S adds +1 for a document that fails an even
   number of the filters in S, and -1 for an odd number. That is the transform of the mask counts.
4. The transform is its own inverse but for the factor 32, so mask counts come back exactly. All 120 orders are then
   read off the 32 counts of a part: a filter removes what fails it and none before it.
5. Shapley: in all 120 orders together, a document with k failures is removed by each of the k filters in 120 / k
   orders, a whole number for k from 1 to 5; so the sum over orders needs the mask counts only.

Defined cases: a null text is empty (under 50 words, so it fails the first filter; equal to other empty texts); a null or
empty part is the part ''; a null id has no smaller id and is smaller than none, so such a row fails no duplicate test,
and has no labels; rows of one id count each, and repeated rows of the smallest id are no duplicates of one another; several
label rows of an id count as one that has each mark that any has; missing or null labels are not 1; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTERS = "ABCDE"
MASKS = 1 << len(LETTERS)
LABELS = ("all", "good", "toxic")


def text_failures(text: Column) -> list[Column]:
    """Failure of the four filters that look at one text, from the non-null ``text`` and its array column ``words``."""
    n = F.size("words").cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return [n < 50, 100 * F.size(F.array_distinct("words")).cast("long") < 65 * n, 100 * capitals > 5 * F.length(text).cast("long"), text.rlike("[#$%&*|]")]


def _number(bits: list[Column]) -> Column:
    return sum((F.when(b, 1 << k).otherwise(0) for k, b in enumerate(bits)), F.lit(0))


def _sign(mask: Column, chosen) -> Column:
    """+1 where ``mask`` has an even number of the bits ``chosen``, else -1."""
    return 1 - 2 * F.bit_count(mask.bitwiseAND(chosen)).bitwiseAND(F.lit(1))


def masks(docs: DataFrame, labels: DataFrame, part: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, good, toxic, mask, n): documents of each failure mask; several rows may have the same key."""
    d = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    d = d.select("id", "part", "t", F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), "").alias("words"))
    d = d.select("id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), _number(text_failures(F.col("t"))).alias("m"))
    d = d.groupBy("id", "part", "digest", "m").agg(F.count("*").alias("n"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # rows without an id have no labels; the digest spreads them over the join's partitions
    d = d.withColumn("spread", F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0)))
    d = d.join(marks.withColumn("spread", F.lit(0).cast("long")), ["id", "spread"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    g = d.groupBy("digest", "part", "m", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id"), F.min("id").alias("least"), F.min_by("n", "id").alias("n_least"),
    )
    g = g.withColumn("first", F.min("least").over(Window.partitionBy("digest")))
    once = F.col("no_id") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    both = F.array(F.struct(F.col("m").alias("mask"), once.alias("n")), F.struct((F.col("m") + 16).alias("mask"), (F.col("n") - once).alias("n")))
    return g.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "good", "toxic", "x.mask", "x.n").where("n > 0")


def parity_sums(counted: DataFrame) -> DataFrame:
    """(part, label, sums): 32 signed parity sums of the documents of each part, of all and of those under each label."""
    under = F.array(F.lit("all"), F.when(F.col("good"), "good"), F.when(F.col("toxic"), "toxic"))
    rows = counted.select("part", "mask", "n", F.explode(F.array_compact(under)).alias("label"))
    return rows.groupBy("part", "label").agg(F.array(*(F.sum(F.col("n") * _sign(F.col("mask"), F.lit(s))) for s in range(MASKS))).alias("sums"))


def mask_cells(sums: DataFrame) -> DataFrame:
    """(part, all, good, toxic): the 32 mask counts of each label, by the inverse transform."""
    index = F.sequence(F.lit(0), F.lit(MASKS - 1))
    total = lambda m: F.aggregate(index, F.lit(0).cast("long"), lambda a, s: a + F.get("sums", s) * _sign(m, s))
    cells = sums.select("part", "label", F.transform(index, lambda m: total(m)).alias("c")).select("part", "label", F.expr(f"transform(c, x -> x div {MASKS})").alias("c"))
    none = F.array_repeat(F.lit(0).cast("long"), MASKS)
    return cells.groupBy("part").agg(*(F.coalesce(F.max(F.when(F.col("label") == k, F.col("c"))), none).alias(k) for k in LABELS))


def orders(cells: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step of it."""
    every = F.lit(["".join(o) for o in itertools.permutations(LETTERS)])
    r = cells.select("*", F.explode(every).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    bit = "shiftleft(1, instr('%s', substr(filter_order, {}, 1)) - 1)" % LETTERS
    r = r.withColumn("own", F.expr(bit.format("step"))).withColumn("past", F.expr(f"aggregate(sequence(1, step), 0, (a, i) -> a | {bit.format('i')})") - F.col("own"))

    def cells_where(label: str, condition: str, weight: str = "1") -> Column:
        return F.expr(f"aggregate(sequence(0, {MASKS - 1}), 0L, (a, m) -> a + if({condition}, {label}[m] * ({weight}), 0L))")

    removed = "m & own <> 0 and m & past = 0"
    return r.select(
        "part", "filter_order", "step", cells_where("all", "m & (own | past) = 0").alias("kept"), cells_where("all", removed).alias("removed"),
        cells_where("all", "m & own <> 0 and m & past <> 0").alias("redundant"), cells_where("all", "m = own").alias("unique_fails"),
        cells_where("good", removed).alias("good_lost"), cells_where("toxic", removed).alias("toxic_lost"), cells_where("all", "m & own <> 0", "120 div bit_count(m)").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What each filter keeps, removes and would remove, for each part, in each order and at each step."""
    return orders(mask_cells(parity_sums(masks(docs, labels, part, doc_id, text))))
