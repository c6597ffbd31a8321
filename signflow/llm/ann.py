"""Nearest neighbours by collision counting over sorted projections.

Vectors are dealt to shards of bounded size. A task sorts a shard's vectors along every random projection once, and
then lets queries pass through it, block after block. A query starts with a bound: the distance of its k-th
nearest among a small sample of all vectors (``PILOT``, the same for all shards), so that no shard has to find out
anew how far is near. It looks at a window around its own projections and widens it step by step (virtual
rehashing: no array is built anew); a vector that lies in the windows of at least ``ALPHA`` of the projections is
verified by its exact distance, which may lower the bound. Widening ends once a vector as far
as the bound has collided in ``MEET`` of the windows on average, and so in ``ALPHA`` with near certainty. The shards' best are merged
by query.

A shard is laid out once for each ``BLOCK`` queries, which keeps tasks short, and queries go to every shard; both
are far fewer copies than a grid of small cells. No task holds more than a shard and a batch of queries, whatever
the table. Null vectors, zero vectors and vectors with null or non-finite components take no part; vectors are
compared with those of their own length. Equal distances go by the smaller vec_id, repeated vectors are separate
candidates, rows of the query's own vec_id are no candidates, with fewer candidates than ``k`` all are returned, an
empty table gives no rows. Columns besides ``vec_id`` and ``embedding`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signflow.llm.common import prepare
from signflow.session import materialize

#: Vectors of a shard and queries of a block, on average; vectors that give a query its first bound, at about most.
SHARD, BLOCK, PILOT = 32_768, 65_536, 4096
#: Random projections at least, share of them that a vector as far as the bound collides in at last, share that a candidate must collide in, growth of the windows.
PROJECTIONS, MEET, ALPHA, GROWTH = 256, 0.683, 0.65, 1.25


def usable(embedding: Column) -> Column:
    """Not null, not zero, all components finite."""
    x = F.filter(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(x) == 0) & F.exists(embedding, lambda v: v != 0), F.lit(False))


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``x``, summed from the first component to the last."""
    return np.sqrt(np.add.accumulate((x - q) ** 2, 1)[:, -1]) if len(x) else np.zeros(0)


def projections(dim: int, least: int = PROJECTIONS) -> np.ndarray:
    """Random orthogonal directions (dim x m), at least ``least`` of them; whole bases spread collisions evenly."""
    rng = np.random.default_rng(dim)
    bases = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-least // dim))]
    return np.concatenate(bases, 1) * np.sqrt(dim)


def reach(dim: int) -> float:
    """Half a window's width, over a vector's distance, at which the vector lies in ``MEET`` of the windows."""
    z = np.random.default_rng(0).standard_normal((20_000, dim))
    return float(np.quantile(np.abs(z[:, 0]) / np.sqrt((z**2).mean(1)), MEET))


@dataclass
class Shard:
    """Vectors in order of their ids, and of each projection the sorted values and their vectors."""

    ids: np.ndarray
    x: np.ndarray
    verified: int = 0
    a: np.ndarray = field(init=False)
    reach: float = field(init=False)

    def __post_init__(self):
        order = np.argsort(self.ids, kind="stable")
        self.ids, self.x = self.ids[order], self.x[order]
        self.a, self.reach = projections(self.x.shape[1]), reach(self.x.shape[1])
        p = (self.x @ self.a).T
        self.order = np.argsort(p, 1, kind="stable")
        self.p = np.take_along_axis(p, self.order, 1)

    def search(self, qid: int, q: np.ndarray, k: int, bound: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nearest vectors as found, and their distances. ``bound``: no more than k vectors of all shards are known to be nearer."""
        m, n = self.p.shape
        centre, need = q @ self.a, int(np.ceil(ALPHA * m))
        counts, done = np.zeros(n, np.int64), self.ids == qid
        low = np.array([np.searchsorted(row, c) for row, c in zip(self.p, centre, strict=True)])
        high = low.copy()
        best_ids, best = np.zeros(0, np.int64), np.zeros(0)
        first = bound if np.isfinite(bound) else float(np.abs(self.p - centre[:, None]).mean())
        half = max(self.reach * first, 1e-12) / GROWTH**3
        while True:
            parts = []
            for j in range(m):
                lo, hi = np.searchsorted(self.p[j], (centre[j] - half, centre[j] + half * (1 + 1e-12)))
                lo, hi = min(lo, low[j]), max(hi, high[j])
                parts += [self.order[j, lo : low[j]], self.order[j, high[j] : hi]]
                low[j], high[j] = lo, hi
            counts += np.bincount(np.concatenate(parts), minlength=n)
            new = np.flatnonzero((counts >= need) & ~done)
            if len(new):
                done[new] = True
                self.verified += len(new)
                best_ids, best = np.concatenate([best_ids, self.ids[new]]), np.concatenate([best, distances(self.x[new], q)])
                top = np.lexsort((best_ids, best))[:k]
                best_ids, best = best_ids[top], best[top]
            limit = min(bound, best[-1] if len(best) == k else np.inf)
            if done.all() or half >= self.reach * limit or (low == 0).all() and (high == n).all():
                return best_ids, best
            half = min(half * GROWTH, max(self.reach * limit, half * 1.0001))


def bounds(pilot_ids: np.ndarray, pilot: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """Each query's distance to its k-th nearest pilot vector; infinite with fewer than k."""
    if len(pilot_ids) <= k:
        return np.full(len(ids), np.inf)
    d = np.maximum((q**2).sum(1)[:, None] + (pilot**2).sum(1) - 2 * q @ pilot.T, 0)
    d[ids[:, None] == pilot_ids] = np.inf
    near = np.sqrt(np.partition(d, k - 1, 1)[:, k - 1])
    return near * (1 + 1e-9) + 1e-9


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, shard: int = SHARD, block: int = BLOCK, pilot: int = PILOT) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest other vectors by Euclidean distance.

    The pilot is drawn by hash of a row's id and vector, so the result does not depend on partitioning. What the shards
    found stays in the shared folder for whoever reads the result.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row for each length of vectors
    n = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    shards, blocks = max(1, -(-n["n"] // shard)), max(1, -(-n["q"] // block))
    lay = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    uniform = F.pmod(F.xxhash64(F.lit("pilot"), "vec_id", "embedding"), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(F.get(F.map_values(F.map_filter(F.create_map(*[x for d, s in sizes.items() for x in (F.lit(d), F.lit(min(1.0, pilot / s)))]), lambda d, _: d == F.col("dim"))), F.lit(0)), F.lit(0.0)) if sizes else F.lit(0.0)
    sampled: dict[int, list] = {}
    for r in rows.where(uniform < share).select("dim", "vec_id", "embedding").collect():  # about ``pilot`` of each length
        sampled.setdefault(r["dim"], []).append((r["vec_id"], r["embedding"]))
    held = spark.sparkContext.broadcast({d: (np.array([i for i, _ in x], np.int64), np.array([v for _, v in x])) for d, x in sampled.items()})
    base = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.hash("embedding")), F.lit(shards)).cast("int")).withColumn("block", lay(blocks)).withColumn("asks", F.lit(False))
    asked = rows.where("asks").withColumn("block", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", lay(shards))
    keys, columns = ["dim", "shard", "block"], ["dim", "shard", "block", "asks", "vec_id", "embedding"]
    dealt = base.select(columns).unionByName(asked.select(columns)).repartition(*keys).sortWithinPartitions(*keys, "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stock, index = None, [], None
        for b in batches:
            cells = np.stack([np.asarray(b.column(c)) for c in keys], 1)
            asks, ids = b.column("asks").to_numpy(zero_copy_only=False), np.asarray(b.column("vec_id"))
            flat, at = b.column("embedding"), np.concatenate([[0], np.flatnonzero((cells[1:] != cells[:-1]).any(1) | (asks[1:] != asks[:-1])) + 1, [len(ids)]])
            for s, e in zip(at[:-1], at[1:], strict=True):  # rows of one cell, all vectors or all queries
                if s == e:
                    continue
                if (cells[s] != key).any() if key is not None else True:
                    key, stock, index = cells[s], [], None
                x = np.asarray(flat.slice(s, e - s).flatten(), np.float64).reshape(e - s, -1)
                if not asks[s]:
                    stock.append((ids[s:e], x))
                    continue
                if index is None and stock:
                    index = Shard(np.concatenate([i for i, _ in stock]), np.concatenate([v for _, v in stock]))
                    stock = []
                if index is None:
                    continue  # a cell without vectors
                sample = held.value.get(int(key[0]))
                near = bounds(*sample, ids[s:e], x, k) if sample else np.full(e - s, np.inf)
                found = [(i, *index.search(i, q, k, d)) for i, q, d in zip(ids[s:e].tolist(), x, near.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([i for i, _, _ in found], np.int64), [len(v) for _, v, _ in found])), pa.array(np.concatenate([v for _, v, _ in found])), pa.array(np.concatenate([d for _, _, d in found]))], ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    found, _ = materialize(found, "near")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
