"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

Rows with equal vectors are one node, so copies cost no links and a vector that many rows have is no hot group. Nodes fall into
shards by a hash of the vector. A shard's graph is built by insertion: the nodes of a level come one batch after another,
the search of the graph built so far finds a new node's neighbours, the diversity rule chooses among them, links run both
ways and are pruned to a fixed degree. A graph is one row: flat neighbour arrays, vectors and ids as binary, so it is
written once and read by any executor.

Queries go to every shard in blocks, (shard, block) pairs are matched by shard number, and each pair descends from the top
level and goes on with a beam search on the lowest, all its queries in step. A query's candidates of all shards are sorted
by exact distance in double precision, then id. Shards grow with the table to a fixed size, so the searches of a query grow
with the table's size divided by that, and no task grows with the table.

Vectors that are null, zero, of another length than most, or with null or non-finite components take no part, and
neither do null ids. Repeated ids are separate candidates. Fewer candidates than k give as many rows. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import session_ready

#: Distinct vectors of a shard, at least and at most; shards of the least size until there are MANY of them.
LEAST, MOST, MANY = 4096, 1 << 16, 64
#: Queries that go to a shard together, and those that step through its graph together.
QUERIES, STEPS = 8192, 256
#: Nodes that are inserted together, and nodes that the search for a new node's neighbours holds.
INSERTED, WIDE = 256, 64


class Graph:
    """A hierarchical navigable small-world graph by insertion: a new node's neighbours are found by searching the graph
    that is there, then chosen by the diversity rule.

    Nodes are numbered by level, the highest first, so the nodes of each level are the first `counts[level]`.
    links[level]: an array of so many rows with node numbers, -1 where a node has fewer neighbours. Vectors have to come in
    random order.
    """

    def __init__(self, vectors: np.ndarray, degree: int = 16, seed: int = 7):
        self._keep(vectors)
        chance = np.random.Generator(np.random.PCG64(seed))
        top = np.minimum((-np.log(1 - chance.random(len(vectors))) / np.log(degree)).astype(int), 6)
        self.counts = [int((top >= level).sum()) for level in range(top.max(initial=0) + 1)] if len(vectors) else []
        self.links: list[np.ndarray] = [np.zeros((0, 0), np.int32)] * len(self.counts)
        for level in reversed(range(len(self.counts))):
            self.links[level] = self._insert(level, 2 * degree if level == 0 else degree)

    def _keep(self, vectors: np.ndarray) -> None:
        # Paths are found in single precision; results are scored in double.
        self.vectors, self.near = vectors, vectors.astype(np.float32)
        self.norms = (self.near**2).sum(axis=1)

    def _insert(self, level: int, degree: int) -> np.ndarray:
        count = self.counts[level]
        links = np.full((count, 2 * degree), -1, np.int32)  # twice the room, so that few nodes are pruned often
        size = [0] * count

        def link(node: int, other: int) -> None:
            if size[node] == 2 * degree:
                self._prune(links, node, degree)
                size[node] = degree
            links[node, size[node]] = other
            size[node] += 1

        for lo in range(0, count, INSERTED):
            hi = min(count, lo + INSERTED)
            own = self.near[lo:hi]
            # Nodes that are inserted together know those before them by comparison, and the graph by search.
            far = self.norms[None, lo:hi] - 2 * own @ own.T
            if lo:
                start = self._descend(own, level)
                found, found_far = self._beam(own, np.where(start < lo, start, 0), links[:lo], WIDE)
            for r in range(hi - lo):
                cand, mine = np.arange(lo, lo + r), far[r, :r]
                if lo:
                    have = found[r] >= 0
                    cand, mine = np.concatenate([found[r][have], cand]), np.concatenate([found_far[r][have], mine])
                by = np.argsort(mine, kind="stable")[:WIDE]
                for c in self._diverse(cand[by], mine[by] + self.norms[lo + r], degree // 2):
                    link(lo + r, c)
                    link(c, lo + r)
        for node in np.flatnonzero(np.array(size) > degree).tolist():
            self._prune(links, node, degree)
        return np.ascontiguousarray(links[:, :degree])

    def _prune(self, links: np.ndarray, node: int, degree: int) -> None:
        """The `degree` neighbours that the diversity rule takes, then the nearest others."""
        cand = links[node][links[node] >= 0]
        far = self.norms[cand] + self.norms[node] - 2 * self.near[cand] @ self.near[node]
        by = np.argsort(far, kind="stable")
        cand = cand[by]
        taken = self._diverse(cand, far[by], degree)
        rest = cand[~np.isin(cand, taken)].tolist()
        links[node] = -1
        links[node, :degree] = [*taken, *rest][:degree]

    def _diverse(self, cand: np.ndarray, far: np.ndarray, most: int) -> list[int]:
        """Nearest first, a candidate is taken if it is nearer to the node than to each one taken before."""
        v = self.near[cand]
        between = self.norms[cand][:, None] + self.norms[cand][None] - 2 * v @ v.T
        taken: list[int] = []
        open_ = np.ones(len(cand), bool)
        for k in range(len(cand)):
            if open_[k]:
                taken.append(k)
                if len(taken) == most:
                    break
                open_ &= far <= between[k]
        return cand[taken].tolist()

    def _far(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances of each query to its row of nodes, without the query's own norm."""
        return self.norms[nodes] - 2 * np.matmul(self.near[nodes], queries[:, :, None])[:, :, 0]

    def _descend(self, queries: np.ndarray, level: int) -> np.ndarray:
        """The nearest node that greedy steps from the top find above `level`, for each query."""
        now = np.zeros(len(queries), np.int64)
        best = self._far(queries, now[:, None])[:, 0]
        for above in range(len(self.counts) - 1, level, -1):
            todo = np.arange(len(queries))
            while len(todo):
                rows = self.links[above][now[todo]]
                far = np.where(rows >= 0, self._far(queries[todo], rows), np.inf)
                k = far.argmin(axis=1)
                nearest = far[np.arange(len(todo)), k]
                closer = nearest < best[todo]
                todo, k, rows, nearest = todo[closer], k[closer], rows[closer], nearest[closer]
                now[todo], best[todo] = rows[np.arange(len(todo)), k], nearest
        return now

    def _beam(self, queries: np.ndarray, start: np.ndarray, links: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the `width` nearest nodes found from its start on, nearest first, -1 where there are fewer; all
        queries step together, each to its nearest node whose neighbours it has not looked at."""
        m = len(queries)
        nodes = np.full((m, width), -1, np.int32)
        far = np.full((m, width), np.inf, np.float32)
        done = np.ones((m, width), bool)
        seen = np.zeros((m, len(links)), bool)
        nodes[:, 0], far[:, 0], done[:, 0] = start, self._far(queries, start[:, None])[:, 0], False
        seen[np.arange(m), start] = True
        todo = np.arange(m)
        while True:
            k = done[todo].argmin(axis=1)
            some = ~done[todo, k]
            todo, k = todo[some], k[some]
            if not len(todo):
                return nodes, far
            done[todo, k] = True
            rows = links[nodes[todo, k]]
            new = (rows >= 0) & ~seen[todo[:, None], rows]
            r, c = np.nonzero(new)
            seen[todo[r], rows[r, c]] = True
            here = np.full(rows.shape, np.inf, np.float32)
            here[r, c] = self.norms[rows[r, c]] - 2 * np.einsum("ij,ij->i", self.near[rows[r, c]], queries[todo[r]])
            closer = np.flatnonzero(here.min(axis=1) < far[todo, -1])
            if not len(closer):
                continue
            at = todo[closer]
            far_all = np.concatenate([far[at], here[closer]], axis=1)
            by = np.argsort(far_all, axis=1, kind="stable")[:, :width]
            take = lambda old, fresh: np.take_along_axis(np.concatenate([old, fresh], axis=1), by, axis=1)  # noqa: B023, E731
            nodes[at], done[at] = take(nodes[at], rows[closer]), take(done[at], ~new[closer])
            far[at] = np.take_along_axis(far_all, by, axis=1)
            empty = np.isinf(far[at])
            nodes[at] = np.where(empty, -1, nodes[at])
            done[at] |= empty

    def search(self, queries: np.ndarray, width: int) -> np.ndarray:
        """(queries, width): the nearest nodes found, nearest first, -1 where there are fewer."""
        if not self.counts or not len(queries):
            return np.full((len(queries), width), -1, np.int32)
        queries = queries.astype(np.float32)
        parts = [queries[i : i + STEPS] for i in range(0, len(queries), STEPS)]
        return np.concatenate([self._beam(part, self._descend(part, 0), self.links[0], width)[0] for part in parts])

    def pack(self) -> dict:
        return {"links": [x.tobytes() for x in self.links], "counts": self.counts, "vectors": self.vectors.tobytes(), "dim": self.vectors.shape[1]}

    @classmethod
    def unpack(cls, row: dict) -> Graph:
        g = cls.__new__(cls)
        g._keep(np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"]))
        g.counts = list(row["counts"])
        g.links = [np.frombuffer(x, np.int32).reshape(n, -1) for x, n in zip(row["links"], g.counts, strict=True)]
        return g


def usable(vector: Column) -> Column:
    """Not null, not zero, no component null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0), F.lit(False))


def shard_number(distinct: int) -> int:
    """Shards of LEAST vectors, until there are MANY; then MANY, until they have MOST; then shards of MOST."""
    return max(1, min(-(-distinct // LEAST), MANY), -(-distinct // MOST))


def search(
    candidates: DataFrame, queries: DataFrame, k: int = 10, width: int = 96, degree: int = 16, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest candidates found for each query, without those of the query's own id.

    width: nodes that a search of a shard of LEAST vectors holds, more with the root of a shard's size; degree: links of a
    node, twice as many on the lowest level.
    """
    spark = candidates.sparkSession
    session_ready(spark)

    def columns(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
        return rows.select("id", F.transform("v", lambda x: x.cast("double")).alias("v"))

    rows = columns(candidates)
    dim = rows.agg(F.mode(F.size("v"), True).alias("dim")).first()["dim"] or 0
    # Rows with equal vectors are one node, with their k + 1 least ids, each k times at most: no query can get another of them.
    # The limit is taken in each task first, so a vector that many rows have is no group of many rows.
    least = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    copy = F.row_number().over(Window.partitionBy("v", "id").orderBy("id"))
    nodes = (
        rows.where(F.size("v") == dim)
        .withColumn("n", least)
        .where(F.col("n") <= k + 1)
        .withColumn("m", copy)
        .where(F.col("m") <= k)
        .groupBy("v")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .checkpoint()
    )
    distinct = nodes.count()
    shards = shard_number(distinct)
    held = max(k + 1, round(width * math.sqrt(max(1.0, distinct / shards / LEAST))))
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    asked = columns(queries).where(F.size("v") == dim)

    def build(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        vectors = np.array(own["v"].tolist(), np.float64).reshape(-1, dim)
        # In an order that depends on the vectors alone; insertion is in random order, as a sorted one would make long chains.
        by = np.lexsort(vectors.T[::-1])
        by = by[np.random.Generator(np.random.PCG64(zlib.crc32(str(key).encode()))).permutation(len(by))]
        ids = [list(own["ids"].iloc[x]) for x in by.tolist()]
        flat = np.array([x for row in ids for x in row], np.int64)
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int64)
        return pd.DataFrame([{"shard": key[0], **Graph(vectors[by], degree).pack(), "ids": flat.tobytes(), "first": ends.tobytes()}])

    graph_schema = "shard int, links array<binary>, counts array<int>, vectors binary, dim int, ids binary, first binary"
    graphs = nodes.repartition(shards, "shard").groupBy("shard").applyInPandas(build, graph_schema).checkpoint()
    # Every query goes to every shard, as any of them may hold a neighbour; both are few: blocks of QUERIES and shards of MOST.
    blocks = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(max(1, -(-asked.count() // QUERIES)))).cast("int")
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), blocks.alias("block"), "id", "v")
    asked = asked.groupBy("shard", "block").agg(F.collect_list(F.struct("id", "v")).alias("q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(name)[r].as_py() for name in ("links", "counts", "vectors", "dim", "ids", "first")}
                asked_ids, asked_vectors = _block(batch.column("q").slice(r, 1), dim)
                yield _answers(row, asked_ids, asked_vectors, k, held)

    # A graph and a block of queries meet by the shard's number; one pair is one row.
    found = asked.join(graphs, "shard").mapInArrow(run, "query_id long, vec_id long, score double")
    # Spark limits each task's rows of a query to k before they are dealt out by query.
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _block(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block of queries."""
    rows = column.flatten()
    return rows.field("id").to_numpy(), rows.field("v").flatten().to_numpy().reshape(-1, dim)


def _answers(row: dict, asked: np.ndarray, vectors: np.ndarray, k: int, width: int) -> pa.RecordBatch:
    """query_id, vec_id, score of the k nearest ids of a shard's nodes for each query, scored in double precision."""
    graph = Graph.unpack(row)
    ids, first = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["first"], np.int64)
    found = graph.search(vectors, width)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q, near in enumerate(found):
        near = near[near >= 0]
        score = np.sqrt(((graph.vectors[near] - vectors[q]) ** 2).sum(axis=1))
        many = first[near + 1] - first[near]
        own = ids[np.repeat(first[near] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        score = np.repeat(score, many)
        by = np.lexsort((own, score))
        by = by[own[by] != asked[q]][:k]
        out.append((np.full(len(by), asked[q]), own[by], score[by]))
    columns = [np.concatenate(x) for x in zip(*out, strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"],
    )


def nearest_of_hundredths(vectors: DataFrame) -> DataFrame:
    """The query rows are those whose vec_id is divisible by 100; candidates are all rows but the query's own."""
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0))
