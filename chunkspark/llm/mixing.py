"""Mixing sources to target weights by balanced sampling with the cube method.

Every source gets a target in words. A document of a source with rate r = target / size is taken floor(r) times,
and once more with the inclusion probability r - floor(r). The cube method settles these probabilities: as long
as three documents of a block are undecided, some of them move along the null space of the balancing constraints
(documents and words), at random in one of two directions and as far as one of them becomes 0 or 1, so the totals of
documents and words stay exact. Blocks hold a bounded number of documents of one
source, so a source of any size is spread over many tasks; what each block leaves undecided, two documents at
most, meets in the next level's blocks, and only the last level lands: there the words' constraint is dropped and
two documents at most, small ones, are settled by chance.

Null text has no words; documents without words are never taken. Null sources form one source, the last.
Rows with repeated ids, or without one, are separate units, told apart by a hash of the text. An empty table gives an empty result. Decisions depend only on the rows and the
seed, so reruns agree.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import WORD, session_ready, text_or_empty, written

BLOCK = 2048
LEVELS = 3
POOL = 24


def flight(prob: list[float], size: list[float], chance: np.random.Generator, land: bool = False) -> list[float]:
    """Move the probabilities until two at most are fractional, or, with `land`, none.

    POOL undecided documents move at a time, in the direction of the null space that moves the largest one most: the
    projection of its axis, with the documents' and words' constraints taken out. Sizes should come in falling order:
    large documents are then settled among their like, and what is left to land is small.
    """
    prob = list(prob)
    pool: list[int] = []
    draws = iter(chance.random(2 * len(prob) + 8).tolist())

    def settle(direction: list[float]) -> bool:
        if max(map(abs, direction)) < 1e-9:
            return False
        up = down = float("inf")
        for k, u in zip(pool, direction, strict=True):
            p = prob[k]
            if u > 1e-12:
                up, down = min(up, (1 - p) / u), min(down, p / u)
            elif u < -1e-12:
                up, down = min(up, -p / u), min(down, (p - 1) / u)
        step = up if next(draws) * (up + down) < down else -down
        for k, u in zip(pool, direction, strict=True):
            p = prob[k] + step * u
            prob[k] = 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p
        pool[:] = [k for k in pool if 0 < prob[k] < 1]
        return True

    def move() -> bool:
        m = len(pool)
        own = [size[k] for k in pool]
        mean = sum(own) / m
        around = [x - mean for x in own]
        spread = sum(x * x for x in around)
        for a in sorted(range(m), key=lambda k: -own[k]):
            pull = around[a] / spread if spread > 1e-9 else 0.0
            if settle([(k == a) - 1 / m - pull * x for k, x in enumerate(around)]):
                return True
        return False

    for k, p in enumerate(prob):
        if 0 < p < 1:
            pool.append(k)
            if len(pool) == POOL:
                move()
    while len(pool) > 2 and move():
        pass
    while land and pool:
        settle([1.0, -1.0] if len(pool) == 2 else [1.0])
    return prob


def targets(sources: DataFrame, cap: float = 3.0, weights: Iterable[float] = (1, 2, 3)) -> DataFrame:
    """`sources`: source, n_docs, source_size, one row a source. Adds weight and target.

    By code point, null last, sources weigh the `weights` in turn and share the total of all sizes; a target stops
    at `cap` times its source's size and the excess is shared again by weight. With sources in the order of
    cap * size / weight, the level of the first source that stays below its cap is the level of all that do.
    """
    weights = list(weights)
    order = Window.orderBy(F.col("source").isNull(), "source")
    every = Window.orderBy("ratio", F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    s = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1))
    s = s.withColumn("ratio", cap * F.col("source_size") / F.col("weight"))
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("filled", F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0.0)))
    s = s.withColumn("rest", F.sum("weight").over(every.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.sum("source_size").over(whole) - F.col("filled")) / F.col("rest"))
    s = s.withColumn("level", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(whole)["level"])
    return s.select(
        "source",
        "n_docs",
        "source_size",
        "weight",
        F.coalesce(F.least(cap * F.col("source_size"), F.col("level") * F.col("weight")), cap * F.col("source_size")).cast("double").alias("target"),
    )


def mix_sources(docs: DataFrame, cap: float = 3.0, weights: Iterable[float] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (words) for each row of `docs` (doc_id, text, source)."""
    return mixed_units(docs, cap, weights, seed).drop("row")


def mixed_units(docs: DataFrame, cap: float = 3.0, weights: Iterable[float] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """The same with row, a hash of the text: rows of one id, or without one, are told apart by it."""
    session_ready(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sized = docs.select(
        "doc_id", F.xxhash64("text").alias("row"), "source", F.regexp_count(text_or_empty("text"), F.lit(WORD)).cast("long").alias("size"),
    ).checkpoint()
    goal = targets(sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size")), cap, weights)
    # As many rows as there are sources; Spark broadcasts them if they turn out small.
    rated = sized.join(goal, sized["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    units = rated.select("doc_id", "row", "source", "size", "source_size", "target", "n_docs", F.when(F.col("size") > 0, rate).otherwise(0.0).alias("rate"))
    units = units.select("*", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("prob")).drop("rate")
    schema = f"doc_id {id_type}, row long, source string, size long, source_size long, target double, n_docs long, whole long, prob double"
    open_ = (F.col("prob") > 1e-9) & (F.col("prob") < 1 - 1e-9)
    columns = [c.split(" ")[0] for c in schema.split(", ")]

    def settle(level: int):
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["size", "doc_id", "row"], ascending=[False, True, True], kind="stable")
            chance = np.random.Generator(np.random.PCG64(zlib.crc32(f"{seed}|{level}|{key!r}".encode())))
            rows["prob"] = flight(rows["prob"].tolist(), rows["size"].astype(float).tolist(), chance, level == LEVELS - 1)
            return rows[columns]

        return run

    done = [units.where(~open_)]
    left = units.where(open_)
    for level in range(LEVELS):
        # A block's documents shrink to two at most, so each level needs BLOCK / 2 times fewer blocks.
        blocks = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / (BLOCK * (BLOCK / 2) ** level))) if level < LEVELS - 1 else F.lit(1)
        left = (
            left.select(*columns, F.pmod(F.xxhash64("doc_id", "row", F.lit(level)), blocks).alias("block"))
            .groupBy("source", "block")
            .applyInPandas(settle(level), schema)
        )
        if level < LEVELS - 1:
            left = left.checkpoint()
            done.append(left.where(~open_))
            left = left.where(open_)
        else:
            done.append(left)
    out = done[0].select(columns)
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("whole") + F.round("prob")).cast("long")
    return out.select("doc_id", "row", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with all their columns, each as many times as it is taken."""
    # Rows of one id, source and text are the same: together they are taken as often as all of them.
    keys = {"__mix_id": F.col("doc_id"), "__mix_source": F.col("source"), "__mix_row": F.col("row")}
    units = mixed_units(docs, **options).groupBy(*[c.alias(name) for name, c in keys.items()])
    taken = written(units.agg(F.sum("copies").alias("__mix_copies"), F.count("*").alias("__mix_m")).where("__mix_copies > 0"))
    keyed = docs.withColumn("__mix_key", F.xxhash64("text"))
    same = (keyed["__mix_key"] == taken["__mix_row"]) & keyed["doc_id"].eqNullSafe(taken["__mix_id"]) & keyed["source"].eqNullSafe(taken["__mix_source"])
    found = keyed.join(taken.hint("shuffle_hash"), same).withColumn("__mix_n", F.lit(1))
    if not taken.where("__mix_m > 1").isEmpty():
        # Which of the equal rows has which number makes no difference to their texts.
        found = found.withColumn("__mix_n", F.row_number().over(Window.partitionBy("__mix_key", "doc_id", "source").orderBy(F.lit(1))))
    times = F.expr("__mix_copies DIV __mix_m + CAST(__mix_n <= __mix_copies % __mix_m AS BIGINT)")
    return found.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.when(times > 0, times)))).select(*[f"`{c}`" for c in docs.columns])
