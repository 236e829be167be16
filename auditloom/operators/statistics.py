"""Resampling statistics on note counts. Randomness is a hash, so that runs repeat anywhere.

Statistics of a replicate follow from sums over its notes, so nothing but sums leaves a task, and no draw is a row.

- ``bootstrap`` and ``randomization`` hash (seed, stream, replicate, note), a form that SQL can state. A note has an independent Poisson(1)
  weight in each replicate, which is what n draws with replacement come to for large n.
- ``resample`` draws n of the n notes with replacement, exactly. Notes with equal counts are one cell (``cells_of``, written once and read by every
  contrast); a hash deals cells to buckets. A replicate's n draws are split over the buckets by one multinomial draw, which every task repeats from the same key, and a
  bucket's share over its cells inside its task: so the weights of a replicate sum to n, though no task sees more than its buckets. The work follows the different count vectors where notes are many, and the draws where they are few.
  In randomised replicates (``randomised``) a note that changes sides moves the difference of its sides, and each swap has coins of its own: so the
  cells are the different differences of one swap, of which Binomial(m, 1/2) of m notes move. They are few (some hundred where sides are counts of a note's codes), however many notes there are.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import f1, safe_ratio, u32
from ..scratch import Scratch

#: Cumulative probabilities of Poisson(1) in units of 2**-32.
POISSON = [math.floor(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(13)]


def number(df: DataFrame, by: str) -> DataFrame:
    """``pos`` from 0 in the order of the unique column ``by``: offsets of ranges plus the number inside a range."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Range bounds are sampled anew by every execution: written, the rows and the offsets see the same ranges, also after a loss.
    r = Scratch(spark, "number").save(df.repartitionByRange(n, by).withColumn("_r", F.spark_partition_id()), "ranges")
    local = F.row_number().over(Window.partitionBy("_r").orderBy(by))
    sizes = r.groupBy("_r").agg(F.count("*").alias("_n"))
    offset = sizes.select("_r", F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))  # one row a range
    return r.withColumn("_l", local).join(F.broadcast(offset), "_r").select(*df.columns, (F.col("_l") - 1 + F.col("_o")).cast("long").alias("pos"))


def number_small(df: DataFrame, by: str) -> DataFrame:
    """As ``number`` by one window: for tables of labels or runs, whose size doesn't follow the corpus."""
    return df.withColumn("pos", (F.row_number().over(Window.orderBy(by)) - 1).cast("long"))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts of both runs on their common notes."""
    x = a.select("note", *[F.col(c).alias(f"{c}_a") for c in a.columns if c != "note"])
    y = b.select("note", *[F.col(c).alias(f"{c}_b") for c in b.columns if c != "note"])
    return x.join(y, "note")


def poisson(u: Column) -> Column:
    """A Poisson(1) number from a uniform whole number below 2**32."""
    out = F.lit(0)
    for limit in POISSON:
        out = out + (u >= limit).cast("int")
    return out


def bootstrap(rows: DataFrame, replicates: int, seed: int, stats: dict[str, Column]) -> DataFrame:
    """(rep, each statistic) from the weighted sums of all columns but ``note``."""
    cols = [c for c in rows.columns if c != "note"]
    each = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    each = each.withColumn("w", poisson(u32(F.lit(str(seed)), F.lit("boot"), F.col("rep"), F.col("note"))))
    sums = each.groupBy("rep").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in cols])
    return sums.select("rep", *[v.alias(k) for k, v in stats.items()])


CELLS_A_BUCKET = 4096  #: cells of a bucket, on average
AT_ONCE = 512  #: replicates that are drawn at once


def _generator(*key) -> np.random.Generator:
    digest = hashlib.blake2b(repr(key).encode(), digest_size=16).digest()
    return np.random.Generator(np.random.Philox(key=np.frombuffer(digest, np.uint64)))


def cells_of(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(columns..., m): the different count vectors of ``rows`` and how many notes have each. ``rows`` may be cells themselves."""
    cols = columns or [c for c in rows.columns if c not in ("note", "m")]
    n = F.sum("m") if "m" in rows.columns else F.count("*")
    return rows.groupBy(*(F.col(c).cast("long").alias(c) for c in cols)).agg(n.alias("m"))


def draws_of(n: np.ndarray, m: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """(replicates, cells): how the n draws of each replicate fall on cells of m notes. Binomial splits over the cells of many notes and all others together, whose share is drawn by index."""
    few = m <= 8
    owner, cells, out = np.repeat(np.arange(int(few.sum())), m[few]), int(few.sum()), np.zeros((len(n), len(m)), np.int64)
    if not few.all():
        p = np.append(m[~few], m[few].sum())
        split = rng.multinomial(n, p / p.sum())
        out[:, ~few], n = split[:, :-1], split[:, -1]
    step = max(1, 2**20 // (len(owner) + 1))  # replicates whose draws are held at once
    for at in range(0, len(n) if cells else 0, step):
        own = n[at : at + step]
        reps = np.repeat(np.arange(len(own)) * cells, own)
        out[at : at + step, few] = np.bincount(reps + owner[rng.integers(0, len(owner), len(reps))], minlength=len(own) * cells).reshape(-1, cells)
    return out


def resample(rows: DataFrame, replicates: int, seed: int, swaps: list[tuple[list[str], list[str]]] | None = None) -> DataFrame:
    """(rep, the sum of each column, drawn) of bootstrap replicates or, with ``swaps``, of randomised ones. ``rows``: notes or cells.

    A swap is a pair of column lists that change sides note by note with probability 1/2, each pair by coins of its own. ``drawn``: the notes of
    a replicate, always as many as there are. The same seed gives the same sums, however the rows are dealt.
    """
    if swaps is not None:
        return randomised(rows, replicates, seed, swaps)
    cells = cells_of(rows)
    cols = [c for c in cells.columns if c != "m"]
    buckets, cells = _dealt(cells, cols)
    sizes = np.zeros(buckets, np.int64)
    for r in cells.groupBy("_b").agg(F.sum("m").alias("m")).collect():  # one row a bucket
        sizes[r["_b"]] = r.m
    notes = int(sizes.sum())

    def own(x: np.ndarray, m: np.ndarray, b: int) -> np.ndarray:
        """(replicates, columns): the sums of a bucket."""
        out = np.zeros((replicates, len(cols) + 1), np.int64)
        x1 = np.c_[x, np.ones(len(x), np.int64)].astype(float)
        for k, at in enumerate(range(0, replicates, AT_ONCE)):
            size = min(AT_ONCE, replicates - at)
            share = _generator(seed, "split", k).multinomial(notes, sizes / notes, size)[:, b]
            out[at : at + size] = np.rint(draws_of(share, m, _generator(seed, "boot", b, k)) @ x1)
        return out

    return _summed(cells, cols, [*cols, "drawn"], buckets, replicates, own)


def _dealt(cells: DataFrame, cols: list[str]) -> tuple[int, DataFrame]:
    """The number of buckets, and ``cells`` with the bucket ``_b`` of each."""
    buckets = max(1, -(-cells.count() // CELLS_A_BUCKET))
    return buckets, cells.select(*cols, "m", F.expr(f"int(pmod(xxhash64({', '.join(f'`{c}`' for c in cols)}), {buckets}))").alias("_b"))


def _summed(cells: DataFrame, cols: list[str], names: list[str], buckets: int, replicates: int, own) -> DataFrame:
    """(rep, names...): the sums over all buckets of ``own(x, m, b)``, a bucket's (replicates, names) numbers."""

    def run(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            a = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(cols) + 2)], axis=1).astype(np.int64)
            for b in np.unique(a[:, -1]).tolist():
                held.setdefault(b, []).append(a[a[:, -1] == b, :-1])
        total = np.zeros((replicates, len(names)), np.int64)
        for b, parts in held.items():
            a = np.concatenate(parts)
            a = a[np.lexsort(a.T[::-1])]  # the order in which cells came doesn't matter
            total += own(a[:, :-1], a[:, -1], b)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates), pa.int64()), *(pa.array(t) for t in total.T)], names=["rep", *names])

    # By range, as hashes of a few numbers crowd into a few tasks.
    sums = cells.repartitionByRange(min(buckets, 4096), "_b").mapInArrow(run, "rep long, " + ", ".join(f"`{c}` long" for c in names))
    return sums.groupBy("rep").agg(*[F.sum(c).alias(c) for c in names])


def differences(cells: DataFrame, swaps: list[tuple[list[str], list[str]]]) -> DataFrame:
    """(_s, _d0, ..., m): the different differences of the sides of each swap (by number), other - side, and how many notes have each; those of 0 are left out."""
    width = max(len(side) for side, _ in swaps)
    each = [F.struct(F.lit(i).cast("long").alias("_s"), *((F.col(other[k]) - F.col(side[k]) if k < len(side) else F.lit(0)).cast("long").alias(f"_d{k}") for k in range(width))) for i, (side, other) in enumerate(swaps)]
    rows = cells.select("m", F.explode(F.array(*each)).alias("x")).select("x.*", "m").where(" or ".join(f"_d{k} <> 0" for k in range(width)))
    return rows.groupBy("_s", *(f"_d{k}" for k in range(width))).agg(F.sum("m").alias("m"))


def randomised(rows: DataFrame, replicates: int, seed: int, swaps: list[tuple[list[str], list[str]]]) -> DataFrame:
    """``resample`` with ``swaps``."""
    cells = cells_of(rows)
    cols = [c for c in cells.columns if c != "m"]
    moves = differences(cells, swaps)
    keys = [c for c in moves.columns if c != "m"]
    buckets, moves = _dealt(moves, keys)
    names = [f"_{i}_{k}" for i, (side, _) in enumerate(swaps) for k in range(len(side))]

    def own(x: np.ndarray, m: np.ndarray, b: int) -> np.ndarray:
        """(replicates, names): what a bucket's notes move."""
        out = np.zeros((replicates, len(names)), np.int64)
        spread = np.zeros((len(x), len(names)))  # a difference in the places of its swap
        for j, (i, k) in enumerate((i, k) for i, (side, _) in enumerate(swaps) for k in range(len(side))):
            spread[:, j] = np.where(x[:, 0] == i, x[:, 1 + k], 0)
        for k, at in enumerate(range(0, replicates, AT_ONCE)):
            size = min(AT_ONCE, replicates - at)
            out[at : at + size] = np.rint(_generator(seed, "swap", b, k).binomial(m, 0.5, (size, len(m))) @ spread)
        return out

    moved = _summed(moves, keys, names, buckets, replicates, own)
    total = cells.agg(*[F.coalesce(F.sum(F.col(c) * F.col("m")), F.lit(0)).alias(c) for c in cols], F.coalesce(F.sum("m"), F.lit(0)).alias("drawn"))
    every = rows.sparkSession.range(replicates).withColumnRenamed("id", "rep").crossJoin(F.broadcast(total)).join(moved, "rep", "left")
    change = {c: F.lit(0) for c in cols}
    for i, (side, other) in enumerate(swaps):
        for k, (a, b) in enumerate(zip(side, other, strict=True)):
            x = F.coalesce(F.col(f"_{i}_{k}"), F.lit(0))
            change[a], change[b] = change[a] + x, change[b] - x
    return every.select("rep", *((F.col(c) + change[c]).alias(c) for c in cols), "drawn")


def aligned(rows: DataFrame, runs: list[str]) -> DataFrame:
    """Contingency numbers of all runs on the same notes, and which runs have a note, from one shuffle by note.

    ``rows``: (note, code, mask), any number for a pair; bit 0 of the mask: the code is gold, bit k: run k predicts it (k from 1, in the order of
    ``runs``). A null code stands for a note without codes. One row a note: note, runs (mask of the runs with a code, gold as bit 0) and tp_, fp_, fn_ of each run.
    """
    has = lambda k: F.col("mask").bitwiseAND(F.lit(1 << k)) != 0
    pairs = rows.repartition("note").groupBy("note", "code").agg(F.bit_or("mask").alias("mask"))  # both aggregates keep the partitioning by note
    each = [F.count_if(c).alias(f"{name}_{r}") for k, r in enumerate(runs, 1) for name, c in (("tp", has(0) & has(k)), ("fp", ~has(0) & has(k)), ("fn", has(0) & ~has(k)))]
    return pairs.groupBy("note").agg(F.bit_or("mask").alias("runs"), *each)


def contrasts(rows: DataFrame, stats: dict[str, Column], replicates: int, seed: int, tests: dict[str, list[tuple[list[str], list[str]]]]) -> DataFrame:
    """One row a statistic: name, point, lo, hi (95 % percentile interval), defined (replicates in which it isn't null), verdict and p.

    ``tests`` names the swaps under which a statistic's null hypothesis is exchangeable, and which have all of its columns; p is the add-one share of randomised
    replicates at least as far from 0 as the point, null for statistics without a test.
    """
    rows = Scratch(rows.sparkSession, "contrasts").save(cells_of(rows), "cells")  # derived once, read by the point, the bootstrap and every test
    cols = [c for c in rows.columns if c != "m"]
    long = lambda sums, names, by=(): sums.select(*by, F.explode(F.array(*(F.struct(F.lit(k).alias("name"), stats[k].cast("double").alias("v")) for k in names))).alias("x")).select(*by, "x.*")
    point = long(rows.agg(*[F.sum(F.col(c) * F.col("m")).alias(c) for c in cols]), stats).withColumnRenamed("v", "point")
    drawn = long(resample(rows, replicates, seed), stats).where("v is not null").groupBy("name").agg(F.array_sort(F.collect_list("v")).alias("v"))  # one number a replicate
    at = lambda p: F.element_at("v", (F.least(F.floor(F.lit(p) * F.size("v")), F.size("v") - 1) + 1).cast("int"))
    out = point.join(drawn.select("name", at(0.025).alias("lo"), at(0.975).alias("hi"), F.size("v").cast("long").alias("defined")), "name", "left")
    out = out.withColumn("verdict", F.when((F.col("lo") > 0) | (F.col("hi") < 0), "excludes 0").otherwise("spans 0"))
    extreme = None
    for name, swaps in tests.items():
        need = sorted({c for side in swaps for half in side for c in half}, key=cols.index)
        one = long(resample(cells_of(rows, need), replicates, seed, swaps), [name]).join(F.broadcast(point), "name").where("abs(v) >= abs(point)").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), F.round((F.col("n") + 1) / (replicates + 1), 6).alias("p"))
        extreme = one if extreme is None else extreme.unionByName(one)
    out = out.withColumn("p", F.lit(None).cast("double")) if extreme is None else out.join(F.broadcast(extreme), "name", "left")
    return out.select("name", *(F.round(c, 9).alias(c) for c in ("point", "lo", "hi")), F.coalesce("defined", F.lit(0).cast("long")).alias("defined"), "verdict", "p")


def f1_of(cell: str) -> Column:
    """F1 from the summed columns tp_, fp_ and fn_ of a cell."""
    return f1(F.col(f"tp_{cell}"), F.col(f"fp_{cell}"), F.col(f"fn_{cell}"))


def errors(rows: DataFrame, cells: list[str]) -> DataFrame:
    """tp_ and e_ = fp_ + fn_ of each cell, and ``note`` or ``m``: F1 doesn't ask which errors they are, so fewer vectors are different."""
    return rows.select(*(c for c in ("note", "m") if c in rows.columns), *(x for k in cells for x in (f"tp_{k}", (F.col(f"fp_{k}") + F.col(f"fn_{k}")).alias(f"e_{k}"))))


def f1_by_errors(cell: str) -> Column:
    """F1 from the summed columns tp_ and e_ of a cell."""
    return f1(F.col(f"tp_{cell}"), F.col(f"e_{cell}"), F.lit(0))


def lift_of(cell: str) -> Column:
    """How much likelier a supported code is right than an unsupported one; null where a base is 0."""
    sg, st, ug, ut = (F.col(f"{c}_{cell}") for c in ("sg", "st", "ug", "ut"))
    return F.when((st > 0) & (ut > 0) & (ug > 0), (sg / st) / (ug / ut))


def sides(a: str, b: str, cols: tuple[str, ...] = ("tp", "fp", "fn")) -> tuple[list[str], list[str]]:
    """The columns of two cells that a swap exchanges."""
    return [f"{c}_{a}" for c in cols], [f"{c}_{b}" for c in cols]


def delta_f1(digits: int | None = None) -> Column:
    """F1 of a - F1 of b from summed columns."""
    side = lambda s: f1(F.col(f"tp_{s}"), F.col(f"fp_{s}"), F.col(f"fn_{s}"))
    d = side("a") - side("b")
    return d if digits is None else F.round(d, digits)


def interval(reps: DataFrame, column: str, level: float = 0.95) -> DataFrame:
    """Percentile interval by sorted index int(p * n)."""
    one = reps.agg(F.array_sort(F.collect_list(column)).alias("v"))  # one number a replicate
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    at = lambda p: F.element_at("v", (F.least(F.floor(F.lit(p) * F.size("v")), F.size("v") - 1) + 1).cast("int"))
    return one.select(F.size("v").cast("long").alias("replicates"), at(lo).alias("lo"), at(hi).alias("hi"))


def randomization(rows: DataFrame, replicates: int, seed: int, digits: int | None = None) -> DataFrame:
    """Approximate randomisation of the F1 difference: sides are swapped per note by a hash bit."""
    bit = u32(F.lit(str(seed)), F.lit("swap"), F.col("rep"), F.col("note")) % 2 == 1
    reps = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    cols = ("tp", "fp", "fn")
    sums = reps.groupBy("rep").agg(*[F.sum(F.when(bit, F.col(f"{c}_{o}")).otherwise(F.col(f"{c}_{s}"))).alias(f"{c}_{s}") for c in cols for s, o in (("a", "b"), ("b", "a"))])
    deltas = sums.select("rep", delta_f1(digits).alias("d"))
    seen = rows.agg(*[F.sum(f"{c}_{s}").alias(f"{c}_{s}") for c in cols for s in "ab"]).select(delta_f1(digits).alias("observed"))
    return deltas.crossJoin(F.broadcast(seen)).agg(F.max("observed").alias("observed"), F.round((F.count_if(F.abs("d") >= F.abs("observed")) + 1) / (F.count("*") + 1), 6).alias("p"))


def pruning_nulls(notes: DataFrame) -> DataFrame:
    """(notes, emitted, oracle_f1, random_f1, random_std): the best and the expected micro-F1 of keeping some codes of a shortlist.

    ``notes``: (shortlist, hits, budget, gold), one row a note: the codes of its shortlist, how many of them are gold, how many codes it may keep, its gold
    codes. The oracle keeps gold codes first. Random pruning keeps e = min(budget, shortlist) codes, each choice equally likely, so its hits are hypergeometric: mean
    e h / s and variance e (h / s) (1 - h / s) (s - e) / (s - 1). What is emitted doesn't depend on the choice, so F1 has exact moments: no draw is made.
    """
    c = notes.groupBy("shortlist", "hits", "budget", "gold").agg(F.count("*").alias("m"))  # cells; a handful of numbers each
    s, h, e, m = F.col("shortlist"), F.col("hits"), F.greatest(F.lit(0), F.least("budget", "shortlist")), F.col("m")
    share = F.when(s > 0, h / s).otherwise(0.0)
    spread = F.when(s > 1, e * share * (1 - share) * (s - e) / (s - 1)).otherwise(0.0)
    t = c.agg(F.sum("m").alias("notes"), F.sum(m * e).alias("emitted"), F.sum(m * F.col("gold")).alias("_g"), F.sum(m * F.least(e, h)).alias("_o"), F.sum(m * e * share).alias("_r"), F.sum(m * spread).alias("_v"))
    d = F.col("emitted") + F.col("_g")
    return t.select("notes", "emitted", *(F.when(d > 0, 2 * x / d).alias(k) for k, x in (("oracle_f1", F.col("_o")), ("random_f1", F.col("_r")), ("random_std", F.sqrt("_v")))))


def top_labels(gold: DataFrame) -> DataFrame:
    """(code, n, pos): labels by falling frequency, ties by code."""
    c = gold.groupBy("code").agg(F.count("*").alias("n"))
    return c.withColumn("pos", (F.row_number().over(Window.orderBy(F.desc("n"), "code")) - 1).cast("long"))  # one row a label


def floor_scores(train: DataFrame, gold: DataFrame, grid: list[int]) -> DataFrame:
    """(k, tp, fp, fn, f1) of the constant predictor of the k most frequent training labels, scored on ``gold``: closed form from label counts."""
    top = top_labels(train).select("code", "pos")
    c = gold.groupBy("code").agg(F.count("*").alias("n"))
    total = gold.agg(F.count("*").alias("all"), F.countDistinct("note").alias("notes"))
    ks = gold.sparkSession.createDataFrame([(k,) for k in grid], "k int")
    hit = top.join(c, "code", "left").crossJoin(F.broadcast(ks)).where("pos < k").groupBy("k").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tp"), F.count("*").alias("used"))
    out = hit.crossJoin(F.broadcast(total)).select("k", "tp", (F.col("notes") * F.col("used") - F.col("tp")).alias("fp"), (F.col("all") - F.col("tp")).alias("fn"))
    return out.withColumn("f1", F.round(f1(F.col("tp"), F.col("fp"), F.col("fn")), 9))


def best(df: DataFrame, value: str, *tie: Column) -> DataFrame:
    """The row of the greatest ``value``, ties by the given order."""
    return df.orderBy(F.desc(value), *tie).limit(1)


def ratio(a: str, b: str) -> Column:
    return safe_ratio(F.col(a), F.col(b))
