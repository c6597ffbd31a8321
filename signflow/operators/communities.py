"""Modularity communities in rounds of joins, level by level.

A round weighs, for every node, its community against those of its neighbours (links to it, less what its degree
would have by chance). Communities are dealt to two sides by hash, anew in each round: nodes leave those of one side
for those of the other only, so nothing is left while another enters it. Many nodes may leave or enter one
community at once: they are dealt to ``CLASSES`` places in a hashed line, and a node moves only if it gains even
if all before it and beside it in line had no links with it. So each round raises modularity, and none needs undoing.
When no node wants to move, communities become the nodes of a smaller graph (their inner links its loops), and so on
until nothing moves; then the single nodes are tried again from where they ended, until none moves by itself. A level's graph of up to ``SMALL`` edges is finished in one task, by the same rules with the same
result.

Weights are whole numbers or nearly so (sums up to 2**53 are exact, and then results don't depend on partitioning).
Edges of a node with itself, null ends and weights that are null or not positive are left out; doubled edges add up;
an edge table without rows has no communities. Several graphs can be done together, each with its own modularity.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signflow.functions import skew
from signflow.functions.skew import join_hot, look_up
from signflow.session import discard, materialize, ship

#: Edges of a level's graph (40 bytes each) that one task finishes.
SMALL = 200_000
#: Places in line, and rounds without a move after which a level ends though some would move.
CLASSES, DRY = 256, 8
#: Rounds by which the hashes of one climb from the bottom differ from those of the next.
PASS = 1000
_P = (1 << 31) - 1
_GAIN = 1e-9


def _factor(round_: int, salt: int) -> int:
    return pow(48271, 2 * round_ + salt + 1, _P)


def _hash(x: Column, round_: int, salt: int) -> Column:
    return (F.pmod(x, F.lit(_P)) + 1) * F.lit(_factor(round_, salt)) % F.lit(_P)


def _hashed(x: np.ndarray, round_: int, salt: int) -> np.ndarray:
    return (np.mod(x, _P) + 1) * _factor(round_, salt) % _P


def climb(a: np.ndarray, b: np.ndarray, w: np.ndarray, m2: np.ndarray, round_: int = 0, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, bool]:
    """All levels of a graph (a <= b) in memory, from single nodes or the communities ``start``: its nodes, their communities, and whether any of the nodes moved by itself."""
    names = np.unique(np.concatenate([a, b]))
    current, moved = names if start is None else start, None
    while True:
        nodes, before, found = _level(a, b, w, m2, round_, current if moved is None else None)
        changed = bool((before != found).any())
        current = found if moved is None else found[np.searchsorted(nodes, current)]
        moved = changed if moved is None else moved
        if not changed:
            return names, current, moved
        a, b = (found[np.searchsorted(nodes, x)] for x in (a, b))
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((b, a))
        a, b, w, m2 = a[order], b[order], w[order], m2[order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(a) != 0) | (np.diff(b) != 0)]))
        a, b, w, m2 = a[first], b[first], np.add.reduceat(w, first), m2[first]


def settle(a: np.ndarray, b: np.ndarray, w: np.ndarray, m2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Climbs from the bottom until no node moves there any more: the graph's nodes and their communities."""
    names, current, _ = climb(a, b, w, m2)
    for pass_ in itertools.count(1):
        _, better, moved = climb(a, b, w, m2, PASS * pass_, current)
        if not moved:
            return names, current
        current = better


def _level(a: np.ndarray, b: np.ndarray, w: np.ndarray, m2: np.ndarray, round_: int, start: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, and their communities before and after the rounds of one level."""
    nodes = np.unique(np.concatenate([a, b]))
    ia, ib = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    n = len(nodes)
    k = np.bincount(ia, w, n) + np.bincount(ib, w, n)
    total = np.zeros(n)
    total[ia] = total[ib] = m2
    far = ia != ib
    src, dst, ww = np.concatenate([ia[far], ib[far]]), np.concatenate([ib[far], ia[far]]), np.concatenate([w[far], w[far]])
    label, dry = np.arange(n) if start is None else np.searchsorted(nodes, start), 0
    begin = label.copy()
    while dry < DRY:
        pair, back = np.unique(src * n + label[dst], return_inverse=True)
        kin = np.bincount(back, ww)
        i, c = pair // n, pair % n
        tot = np.bincount(label, k, n)
        inside = np.zeros(n)
        mine = c == label[i]
        inside[i[mine]] = kin[mine]
        stay = inside - k * (tot[label] - k) / total
        base = kin - k[i] * tot[c] / total[i]
        gain = base - stay[i]
        ask = ~mine & (gain > _GAIN * k[i])
        if not ask.any():
            break
        side = _hashed(nodes, round_, 0) >= _P // 2
        ask &= ~side[label[i]] & side[c]
        i, c, gain, base = i[ask], c[ask], gain[ask], base[ask]
        best = np.lexsort((nodes[c], -base, i))
        first = best[np.flatnonzero(np.concatenate([[True], np.diff(i[best]) != 0]))] if len(best) else best
        i, c, gain = i[first], c[first], gain[first]
        place = _hashed(nodes[i], round_, 1) % CLASSES
        crowd = _before(label[i], place, k[i]) + _before(c, place, k[i]) if len(i) else np.zeros(0)
        go = gain > k[i] * (crowd - 2 * k[i]) / total[i]
        label[i[go]] = c[go]
        dry = 0 if go.any() else dry + 1
        round_ += 1
    return nodes, nodes[begin], nodes[label]


def _before(group: np.ndarray, place: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Sum of k over those of one's group up to one's own place in line."""
    key, back = np.unique(group * CLASSES + place, return_inverse=True)
    sums = np.cumsum(np.bincount(back, k))
    start = np.searchsorted(key, (key // CLASSES) * CLASSES)
    return (sums - np.where(start > 0, sums[start - 1], 0.0))[back]


def _finish(level: DataFrame, round_: int | None) -> DataFrame:
    """node, community of a small level's graph, in one task: by one climb, or without a round all that it takes."""
    ship(level.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            graph = [t.column(c).to_numpy() for c in ("a", "b", "w", "m2")]
            found = settle(*graph) if round_ is None else climb(*graph, round_)[:2]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["node", "community"])

    return level.select("a", "b", "w", "m2").repartition(1).mapInArrow(run, "node bigint, community bigint")


def _local_moves(level: DataFrame, round_: int, start: DataFrame | None = None) -> tuple[DataFrame, bool, list[str]]:
    """node, community after the rounds of one level, from single nodes or the communities ``start``; whether any node moved; what it wrote."""
    both, both_path = materialize(level.where("a <> b").select("a", "b", "w").unionByName(level.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "links")
    ends = level.select(F.explode(F.array(F.struct(F.col("a").alias("node"), "w", "m2", (F.col("a") != F.col("b")).cast("bigint").alias("far")), F.struct(F.col("b").alias("node"), "w", "m2", (F.col("a") != F.col("b")).cast("bigint").alias("far")))).alias("x")).select("x.*")
    nodes, path = materialize(ends.groupBy("node").agg(F.sum("w").alias("k"), F.max("m2").alias("m2"), F.sum("far").alias("degree")).withColumn("community", F.col("node")), "nodes")
    if start is not None:
        own, own_path = materialize(nodes.drop("community").join(start, "node"), "nodes")
        discard(nodes.sparkSession, path)
        nodes, path = own, own_path
    size = nodes.agg(F.count("*").alias("n"), F.coalesce(F.sum("degree"), F.lit(0)).alias("links")).first()
    small = size["n"] <= skew.BROADCAST
    dry, ever = 0, False
    while dry < DRY:
        written: list[str] = []

        def kept(df: DataFrame, name: str, written: list[str] = written) -> DataFrame:
            df, p = materialize(df, name)
            written.append(p)
            return df

        around = nodes.select(F.col("node").alias("b"), F.col("community").alias("c"), "degree")
        met = both.join(F.broadcast(around.drop("degree")), "b") if small else join_hot(both, around, ["b"], "degree", size["links"])
        near = met.groupBy("a", "c").agg(F.sum("w").alias("kin"))
        tot = nodes.groupBy(F.col("community").alias("c")).agg(F.sum("k").alias("tot"))
        own = nodes.select(F.col("node").alias("a"), "k", "m2", F.col("community").alias("c"))
        if small:
            near, own = near.join(F.broadcast(tot), "c"), own.join(F.broadcast(tot), "c")
        else:
            tot = kept(tot, "totals")
            near, own = look_up(kept(near, "near"), tot, "c"), look_up(own, tot, "c")
        own = own.select("a", "k", "m2", F.col("c").alias("own"), F.col("tot").alias("own_tot"))
        x = near.join(F.broadcast(own) if small else own, "a").withColumn("base", F.col("kin") - F.col("k") * F.col("tot") / F.col("m2"))
        other = F.col("c") != F.col("own")
        allowed = other & (_hash(F.col("own"), round_, 0) < _P // 2) & (_hash(F.col("c"), round_, 0) >= _P // 2)
        best = x.groupBy("a").agg(
            F.first("k").alias("k"), F.first("m2").alias("m2"), F.first("own").alias("own"), F.first("own_tot").alias("own_tot"), F.max(F.when(~other, F.col("kin"))).alias("inside"),
            F.max(F.when(other, F.col("base"))).alias("top"), F.max(F.when(allowed, F.struct("base", (-F.col("c")).alias("minus")))).alias("best"),
        )
        stay = F.coalesce("inside", F.lit(0.0)) - F.col("k") * (F.col("own_tot") - F.col("k")) / F.col("m2")
        wants = best.withColumn("stay", stay).where(F.col("top") - F.col("stay") > _GAIN * F.col("k"))
        wants = wants.select("a", "k", "m2", "own", (-F.col("best.minus")).alias("to"), (F.col("best.base") - F.col("stay")).alias("gain"), (_hash(F.col("a"), round_, 1) % CLASSES).alias("place"))
        wants = kept(wants, "wants")
        movers = wants.where(F.col("gain") > _GAIN * F.col("k"))
        if not wants.limit(1).count():
            discard(nodes.sparkSession, *written)
            break
        for side in ("own", "to"):
            line = movers.groupBy(side, "place").agg(F.sum("k").alias("here"))  # at most CLASSES rows for a community
            line = line.withColumn(f"crowd_{side}", F.sum("here").over(Window.partitionBy(side).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))).drop("here")
            movers = movers.join(line, [side, "place"])
        go = movers.where(F.col("gain") > F.col("k") * (F.col("crowd_own") + F.col("crowd_to") - 2 * F.col("k")) / F.col("m2")).select(F.col("a").alias("node"), "to")
        go = kept(go, "moves")
        n_moved = go.count()
        if n_moved:
            changed = nodes.join(F.broadcast(go) if small else go, "node", "left")
            moved, new_path = materialize(changed.select("node", "k", "m2", "degree", F.coalesce("to", "community").alias("community")), "nodes")
            discard(nodes.sparkSession, path)
            nodes, path, ever = moved, new_path, True
        discard(nodes.sparkSession, *written)
        dry = 0 if n_moved else dry + 1
        round_ += 1
    return nodes.select("node", "community"), ever, [both_path, path]


def communities(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """node, community (one of its nodes) of every node of ``edges`` (a, b: bigint, weight; graph: bigint, if there are several, whose nodes differ)."""
    spark = edges.sparkSession
    graph = F.col("graph") if "graph" in edges.columns else F.lit(0).cast("bigint")
    kept = edges.where("a is not null and b is not null and a <> b and weight > 0").select(graph.alias("graph"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("weight").cast("double").alias("w"))
    kept = kept.groupBy("graph", "a", "b").agg(F.sum("w").alias("w"))
    base, base_path = materialize(kept, "graph")
    totals = base.groupBy("graph").agg((2 * F.sum("w")).alias("m2"))
    level, level_path = materialize(look_up(base, totals, "graph").select("a", "b", "w", "m2"), "level")
    temporary = [base_path, level_path]

    def kept(df: DataFrame, name: str) -> DataFrame:
        df, path = materialize(df, name)
        temporary.append(path)
        return df

    def above(level: DataFrame, found: DataFrame) -> DataFrame:
        """The graph of a level's communities."""
        ends = kept(look_up(level, found.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a"), "ends")
        ends = look_up(ends, found.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
        return kept(ends.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "w", "m2").groupBy("a", "b").agg(F.sum("w").alias("w"), F.max("m2").alias("m2")), "level")

    def moves(level: DataFrame, round_: int, start: DataFrame | None = None) -> tuple[DataFrame, bool]:
        found, ever, paths = _local_moves(level, round_, start)
        temporary.extend(paths)
        return found, ever

    bottom, whole = level, None
    if bottom.count() <= small:
        whole = _finish(bottom, None)
    for pass_ in itertools.count() if whole is None else ():
        found, ever = moves(bottom, PASS * pass_, whole)
        if not ever and whole is not None:
            break
        whole, level = found, bottom
        while ever:
            level = above(level, found)
            if level.count() <= small:
                found, ever = _finish(level, PASS * pass_), False
            else:
                found, ever = moves(level, PASS * pass_)
            found = kept(found, "found")
            whole = kept(look_up(whole.withColumnRenamed("community", "at"), found.select(F.col("node").alias("at"), "community"), "at").select("node", "community"), "communities")
    out, _ = materialize(whole, "communities")
    discard(spark, *temporary)
    return out


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """graph, modularity of a partition (node, community) of ``edges`` (as above)."""
    graph = F.col("graph") if "graph" in edges.columns else F.lit(0).cast("bigint")
    e = edges.where("a is not null and b is not null and a <> b and weight > 0").select(graph.alias("graph"), "a", "b", F.col("weight").cast("double").alias("w"))
    named = lambda side: members.select(F.col("node").alias(side), F.col("community").alias(f"c{side}"))
    e = e.join(named("a"), "a").join(named("b"), "b")
    inner = e.groupBy("graph").agg(F.sum("w").alias("m"), F.coalesce(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w"))), F.lit(0.0)).alias("inside"))
    ends = e.select("graph", "w", F.explode(F.array("ca", "cb")).alias("c")).groupBy("graph", "c").agg(F.sum("w").alias("k")).groupBy("graph").agg(F.sum(F.col("k") * F.col("k")).alias("squares"))
    return inner.join(ends, "graph").select("graph", (F.col("inside") / F.col("m") - F.col("squares") / (4 * F.col("m") * F.col("m"))).alias("modularity"))
