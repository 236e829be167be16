"""Multi-objective search utilities: Pareto fronts, crowding, knee, hypervolume, spaces and drivers. All objectives are minimised.

Objective tables hold one row per tried configuration, whose number a search budget bounds.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import u32
from ..scratch import Scratch


def _dominates(objs: list[str], a: str, b: str) -> Column:
    le = [F.col(f"{a}.{o}") <= F.col(f"{b}.{o}") for o in objs]
    lt = [F.col(f"{a}.{o}") < F.col(f"{b}.{o}") for o in objs]
    every, some = le[0], lt[0]
    for x in le[1:]:
        every = every & x
    for x in lt[1:]:
        some = some | x
    return every & some


def pareto(points: DataFrame, objs: list[str]) -> DataFrame:
    """The points that no other dominates."""
    return points.alias("p").join(points.alias("q"), _dominates(objs, "q", "p"), "left_anti")


def depth(points: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Fronts of ``points`` that come in lexicographic order, none below ``low``: each lies one behind the last front that dominates it."""
    front = low.copy()
    for i in range(1, len(points)):
        over = (points[:i] <= points[i]).all(1) & (points[:i] < points[i]).any(1)
        if over.any():
            front[i] = max(front[i], front[:i][over].max() + 1)
    return front


def fronts(points: DataFrame, objs: list[str], key: str, block: int = 2048) -> DataFrame:
    """``front`` 0, 1, ... of every point: how many points at most dominate one another in a row down to it. A null or NaN objective counts as infinite.

    Different objective vectors go to blocks in lexicographic order; a vector is dominated only by vectors before it. Blocks are finished in order:
    the finished blocks, each in its task, give the block's vectors their least fronts (those whose best corner isn't below the block's worst are
    left out), then the block is finished in one task. Only a block's vectors are gathered, and each finished block is written once.
    """
    spark = points.sparkSession
    scratch = Scratch(spark, "fronts")
    value = lambda o: F.when(F.col(o).isNull() | F.isnan(F.col(o).cast("double")), F.lit(float("inf"))).otherwise(F.col(o).cast("double"))
    own = points.withColumns({f"_o{i}": value(o) + F.lit(0.0) for i, o in enumerate(objs)})
    cols = [f"_o{i}" for i in range(len(objs))]
    vectors = own.select(*cols).distinct()
    n = max(1, -(-vectors.count() // block))
    dealt = scratch.save(vectors.repartitionByRange(n, *cols).select("*", F.spark_partition_id().alias("_b")), "blocks")
    ends = {r["_b"]: r for r in dealt.groupBy("_b").agg(*(f(c).alias(f"{f.__name__}{c}") for c in cols for f in (F.min, F.max))).collect()}  # one row a block
    schema, done = ", ".join(f"{c} double" for c in cols) + ", front int", {}

    def matrix(b):
        return np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(len(cols))], axis=1)

    for t in sorted(ends):
        mine = np.array(sorted(tuple(r)[:-1] for r in dealt.where(F.col("_b") == t).collect())).reshape(-1, len(cols))  # one block
        before = [done[s] for s in done if all(ends[s][f"min{c}"] <= ends[t][f"max{c}"] for c in cols)]
        low = np.zeros(len(mine), np.int64)
        if before:
            shared = spark.sparkContext.broadcast(mine)

            def least(batches):
                q, out = shared.value, np.zeros(len(shared.value), np.int64)
                for b in batches:
                    p, front = matrix(b), b.column(len(cols)).to_numpy()
                    for i in range(len(q)):
                        over = (p <= q[i]).all(1) & (p < q[i]).any(1)
                        if over.any():
                            out[i] = max(out[i], front[over].max() + 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(q))), pa.array(out)], names=["i", "low"])

            for r in spark.read.schema(schema).parquet(*before).mapInArrow(least, "i long, low long").groupBy("i").agg(F.max("low").alias("low")).collect():  # one block
                low[r.i] = r.low
        start = spark.createDataFrame([(mine.tobytes(), low.tobytes())], "p binary, low binary")

        def finish(batches):
            for b in batches:
                for p, low_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    p = np.frombuffer(p).reshape(-1, len(cols))
                    front = depth(p, np.frombuffer(low_, np.int64))
                    yield pa.RecordBatch.from_arrays([*(pa.array(p[:, i]) for i in range(len(cols))), pa.array(front.astype(np.int32))], names=[*cols, "front"])

        done[t] = scratch.save(start.mapInArrow(finish, schema), f"front-{t}")._scratch_path  # noqa: SLF001
    found = spark.read.schema(schema).parquet(*done.values()) if done else spark.createDataFrame([], schema)
    return own.join(found, cols).drop(*cols)


def crowding(front: DataFrame, objs: list[str], key: str) -> DataFrame:
    """Crowding distance: neighbours' gaps by objective, over its range; infinite at the ends."""
    out = front
    for o in objs:
        w = Window.orderBy(o, key)
        r = F.max(o).over(Window.partitionBy()) - F.min(o).over(Window.partitionBy())
        gap = F.lead(o).over(w) - F.lag(o).over(w)
        out = out.withColumn(f"_{o}", F.when(gap.isNull(), F.lit(float("inf"))).when(r > 0, gap / r).otherwise(0.0))
    total = F.col(f"_{objs[0]}")
    for o in objs[1:]:
        total = total + F.col(f"_{o}")
    return out.withColumn("crowding", F.round(total, 6)).drop(*[f"_{o}" for o in objs])


def knee(points: DataFrame, objs: list[str], key: str) -> DataFrame:
    """The Pareto point of the least sum of objectives, each scaled by its range on the front."""
    f = pareto(points, objs)
    w = Window.partitionBy()
    total = F.lit(0.0)
    for o in objs:
        lo, hi = F.min(o).over(w), F.max(o).over(w)
        total = total + F.when(hi > lo, (F.col(o) - lo) / (hi - lo)).otherwise(0.0)
    return f.withColumn("total", F.round(total, 6)).orderBy("total", key).limit(1)


def hypervolume(points: DataFrame, objs: list[str], samples: int = 2000, seed: int = 42) -> DataFrame:
    """Monte-Carlo share and volume dominated below the reference max + 0.1 * abs(max), above the minima."""
    ends = points.agg(*[F.min(o).alias(f"lo_{o}") for o in objs], *[(F.max(o) + 0.1 * F.abs(F.max(o))).alias(f"hi_{o}") for o in objs])
    s = points.sparkSession.range(samples).crossJoin(F.broadcast(ends))
    s = s.select("id", *[(F.col(f"lo_{o}") + (F.col(f"hi_{o}") - F.col(f"lo_{o}")) * u32(F.lit(str(seed)), F.lit(o), F.col("id")) / float(2**32)).alias(f"s_{o}") for o in objs])
    cond = F.lit(True)
    for o in objs:
        cond = cond & (F.col(o) <= F.col(f"s_{o}"))
    hit = s.join(F.broadcast(points.select(*objs)), cond, "left_semi").agg(F.count("*").alias("hits"))  # one row a configuration
    volume = F.lit(1.0)
    for o in objs:
        volume = volume * (F.col(f"hi_{o}") - F.col(f"lo_{o}"))
    return hit.crossJoin(ends).select("hits", F.round(F.col("hits") / samples * volume, 6).alias("hypervolume"))


class Space:
    """A discrete space: choices by name, encoded as normalised positions."""

    def __init__(self, choices: dict[str, list]):
        self.choices = choices

    def sample(self, rng: random.Random) -> dict:
        return {k: rng.choice(v) for k, v in self.choices.items()}

    def encode(self, config: dict) -> list[float]:
        return [self.choices[k].index(config[k]) / max(1, len(self.choices[k]) - 1) for k in self.choices]

    def decode(self, point: list[float]) -> dict:
        return {k: v[round(min(1.0, max(0.0, x)) * (len(v) - 1))] for (k, v), x in zip(self.choices.items(), point, strict=True)}


Objective = Callable[[dict], list[float]]


def dominates(a: list[float], b: list[float]) -> bool:
    return all(x <= y for x, y in zip(a, b, strict=True)) and any(x < y for x, y in zip(a, b, strict=True))


def _evaluate(objective: Objective, config: dict, n: int) -> list[float]:
    try:
        return list(objective(config))
    except Exception:  # a configuration that fails gets the worst score, and the search goes on
        return [1e9] * n


def _ranked(pop: list[tuple]) -> list[tuple]:
    """Members by front, then by falling crowding distance."""
    left, out = list(pop), []
    while left:
        front = [p for p in left if not any(dominates(q[1], p[1]) for q in left)]
        width = {id(p): 0.0 for p in front}
        for m in range(len(front[0][1])):
            o = sorted(front, key=lambda p: p[1][m])
            width[id(o[0])] = width[id(o[-1])] = float("inf")
            span = (o[-1][1][m] - o[0][1][m]) or 1.0
            for a, b, c in zip(o, o[1:], o[2:], strict=False):
                width[id(b)] += (c[1][m] - a[1][m]) / span
        out += sorted(front, key=lambda p: -width[id(p)])
        left = [p for p in left if not any(p is f for f in front)]
    return out


def random_search(space: Space, objective: Objective, trials: int = 100, n_objectives: int = 5, seed: int = 42) -> list[tuple[dict, list[float]]]:
    rng = random.Random(seed)
    return [(c, _evaluate(objective, c, n_objectives)) for c in (space.sample(rng) for _ in range(trials))]


def nsga2(space: Space, objective: Objective, population: int = 20, generations: int = 10, n_objectives: int = 5, seed: int = 42, eta: float = 20.0, mutation: float = 0.1) -> list[tuple[dict, list[float]]]:
    """Non-dominated-sorting genetic search: simulated binary crossover and polynomial mutation on the encoded space."""
    rng = random.Random(seed)
    pop = _ranked([(space.encode(c), _evaluate(objective, c, n_objectives)) for c in (space.sample(rng) for _ in range(population))])
    for _ in range(generations):
        young = []
        while len(young) < population:
            (x, _), (y, _) = rng.sample(pop, 2)
            child = []
            for a, b in zip(x, y, strict=True):
                u = rng.random()
                beta = (2 * u) ** (1 / (eta + 1)) if u <= 0.5 else (1 / (2 * (1 - u))) ** (1 / (eta + 1))
                v = ((1 + beta) * a + (1 - beta) * b) / 2
                if rng.random() < mutation:
                    u = rng.random()
                    v += (2 * u) ** (1 / (eta + 1)) - 1 if u < 0.5 else 1 - (2 * (1 - u)) ** (1 / (eta + 1))
                child.append(min(1.0, max(0.0, v)))
            c = space.decode(child)
            young.append((space.encode(c), _evaluate(objective, c, n_objectives)))
        pop = _ranked(pop + young)[:population]
    return [(space.decode(x), f) for x, f in pop]


def mopso(space: Space, objective: Objective, swarm: int = 20, steps: int = 10, n_objectives: int = 5, seed: int = 42, w: float = 0.4, c1: float = 2.0, c2: float = 2.0, archive_size: int = 50) -> list[tuple[dict, list[float]]]:
    """Particle swarm with an archive of non-dominated points; guides are drawn evenly from the archive."""
    rng = random.Random(seed)
    at = [space.encode(space.sample(rng)) for _ in range(swarm)]
    fit = [_evaluate(objective, space.decode(x), n_objectives) for x in at]
    speed = [[0.0] * len(x) for x in at]
    own = list(zip(at, fit, strict=True))
    archive = list(own)
    for _ in range(steps):
        archive = [p for p in _ranked(archive) if not any(dominates(q[1], p[1]) for q in archive)][:archive_size]
        for i in range(swarm):
            guide = rng.choice(archive)[0]
            speed[i] = [w * v + c1 * rng.random() * (p - x) + c2 * rng.random() * (g - x) for v, x, p, g in zip(speed[i], at[i], own[i][0], guide, strict=True)]
            at[i] = [min(1.0, max(0.0, x + v)) for x, v in zip(at[i], speed[i], strict=True)]
            fit[i] = _evaluate(objective, space.decode(at[i]), n_objectives)
            if dominates(fit[i], own[i][1]):
                own[i] = (at[i], fit[i])
            archive.append((at[i], fit[i]))
    archive = [p for p in _ranked(archive) if not any(dominates(q[1], p[1]) for q in archive)][:archive_size]
    return [(space.decode(x), f) for x, f in archive]
