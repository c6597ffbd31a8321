"""Co-occurrence, PPMI, embeddings, features and nearest centroids."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signflow.functions.portable import uniform
from signflow.functions.skew import look_up
from signflow.operators import stats
from signflow.session import discard, materialize, ship

#: Queries of a block and base rows of a shard, on average.
BLOCK, SHARD = 4096, 65_536
#: Base rows of a shard from which more shards are made, up to so many, for tasks to share the work.
LEAST, SHARDS = 2048, 48


def cooccurrence(corpus: DataFrame, window: int = 2, *keys: str) -> DataFrame:
    """keys, a, b, n: signs within ``window`` places of each other, both ways, formed inside the row."""
    s = F.col("signs")
    near = F.transform(s, lambda x, i: F.transform(F.filter(F.sequence(F.greatest(i - window, F.lit(0)), F.least(i + window, F.size(s) - 1)), lambda j: j != i), lambda j: F.struct(x.alias("a"), F.get(s, j).alias("b"))))
    return corpus.where(F.size(s) > 1).select(*keys, F.inline(F.flatten(near))).groupBy(*keys, "a", "b").agg(F.count("*").alias("n"))


def ppmi(counts: DataFrame, *keys: str) -> DataFrame:
    """keys, a, b, ppmi of observed pairs (others are 0), each key's by its own counts."""
    margin = lambda c: counts.groupBy(*keys, c).agg(F.sum("n").alias(f"n{c}"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("t"))
    x = counts.join(margin("a"), [*keys, "a"]).join(margin("b"), [*keys, "b"])
    x = x.join(F.broadcast(total), list(keys)) if keys else x.join(F.broadcast(total))
    return x.select(*keys, "a", "b", F.greatest(F.lit(0.0), F.log2(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("ppmi"))


def rows_of(ppmi_table: DataFrame) -> DataFrame:
    """sign, vector: the table's rows over its columns in order, which are a vocabulary."""
    columns = ppmi_table.select(F.col("b").alias("sign")).distinct().agg(F.array_sort(F.collect_list("sign")).alias("signs_"))
    rows = ppmi_table.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("b", "ppmi"))).alias("m_")).join(F.broadcast(columns))
    return rows.select(F.col("a").alias("sign"), F.transform("signs_", lambda x: F.coalesce(F.try_element_at("m_", x), F.lit(0.0))).alias("vector"))


def _gram(table: DataFrame, names: list[str]) -> np.ndarray:
    """Products of all columns with each other: a matrix a task, added up, so that the driver gets one."""
    ship(table.sparkSession)
    k = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for b in batches:
            m = np.stack([b.column(n).to_numpy() for n in names], 1)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), k), pa.int32()), pa.array(np.tile(np.arange(k), k), pa.int32()), pa.array(total.ravel())], ["i", "j", "x"])

    out = np.zeros((k, k))
    for r in table.select(*names).mapInArrow(run, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        out[r["i"], r["j"]] = r["x"]
    return out


def _turned(table: DataFrame, names: list[str], by: np.ndarray) -> DataFrame:
    """sign and the columns ``names`` times a matrix, as x0, x1, ..."""
    width = by.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.stack([b.column(n).to_numpy() for n in names], 1) @ by
            yield pa.RecordBatch.from_arrays([b.column("sign"), *(pa.array(m[:, j]) for j in range(width))], ["sign", *(f"x{j}" for j in range(width))])

    return table.select("sign", *names).mapInArrow(run, "sign string, " + ", ".join(f"x{j} double" for j in range(width)))


def embed(ppmi_table: DataFrame, dims: int = 20, more: int = 20, tolerance: float = 1e-10, rounds: int = 200, seed: int = 0) -> DataFrame:
    """sign, vector: truncated SVD (left vectors times singular values) of a sparse table of any vocabulary.

    Subspace iteration: a basis of ``dims`` + ``more`` columns over the signs, hashed at first, is multiplied by the table
    and back (joins, and a sum for each column), and made orthonormal by the small matrix of its products. It ends when
    the ``dims`` largest singular values no longer change; with a vocabulary no wider than the basis the first round is
    exact. Signs without a positive entry get zeros. The driver holds the small matrices only.
    """
    spark, temporary = ppmi_table.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        df, path = materialize(df, name)
        temporary.append(path)
        return df

    cells = kept(ppmi_table.where("ppmi > 0").select("a", "b", "ppmi"), "cells")
    names = kept(ppmi_table.select(F.col("a").alias("sign")).distinct(), "signs")
    n = names.count()
    if not n:
        return spark.createDataFrame([], "sign string, vector array<double>")
    across = kept(cells.select(F.col("b").alias("sign")).distinct(), "columns")
    m, k = across.count(), max(1, min(dims, n - 1))
    width = max(1, min(m, k + more))
    columns = [f"x{j}" for j in range(width)]
    normal = lambda j: F.sqrt(-2 * F.ln(F.greatest(uniform(seed, "u", F.col("sign"), j), F.lit(1e-9)))) * F.cos(2 * np.pi * uniform(seed, "v", F.col("sign"), j))
    basis = kept(across.select("sign", *[normal(j).alias(f"x{j}") for j in range(width)]), "basis")

    def times(basis: DataFrame, on: str, to: str, names: list[str]) -> DataFrame:
        met = look_up(cells, basis.withColumnRenamed("sign", on), on)
        return kept(met.groupBy(F.col(to).alias("sign")).agg(*[F.sum(F.col("ppmi") * F.col(c)).alias(c) for c in names]), "product")

    def axes(table: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the table's principal axes, falling, and the directions of those that have any."""
        e, v = np.linalg.eigh(_gram(table, names))
        e, v = e[::-1], v[:, ::-1]
        solid = e > max(e[0], 0.0) * 1e-14
        return np.sqrt(e[solid]), v[:, solid]

    lengths, v = axes(basis, columns)
    names_ = columns
    before = None
    for round_ in range(rounds if len(lengths) else 0):
        basis = kept(_turned(basis, names_, v / lengths), "basis")
        names_ = [f"x{j}" for j in range(v.shape[1])]
        left = times(basis, "b", "a", names_)
        lengths, v = axes(left, names_)
        top = lengths[:k]
        if len(names_) >= m or round_ + 1 == rounds or before is not None and len(before) == len(top) and np.abs(top - before).max() <= tolerance * top[0]:
            break
        before = top
        turned = kept(_turned(left, names_, v / lengths), "left")
        names_ = [f"x{j}" for j in range(v.shape[1])]
        basis = times(turned, "a", "b", names_)
        lengths, v = axes(basis, names_)
    zeros = F.array(*[F.lit(0.0)] * k)
    if len(lengths):
        found = _turned(left, names_, v[:, :k])
        flat = [*[F.col(f"x{j}") for j in range(min(k, v.shape[1]))], *[F.lit(0.0)] * (k - min(k, v.shape[1]))]
        out = names.join(found.select("sign", F.array(*flat).alias("vector")), "sign", "left").select("sign", F.coalesce("vector", zeros).alias("vector"))
    else:
        out = names.select("sign", zeros.alias("vector"))
    out, _ = materialize(out, "vectors")
    discard(spark, *temporary)
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(norm, F.lit(0.0)))


def _half_up(x: np.ndarray) -> np.ndarray:
    """``x`` to six places as Spark rounds: by its decimal digits, halves away from zero."""
    out = np.round(x, 6)
    for i in np.flatnonzero(np.abs(np.abs(x * 1e6) % 1 - 0.5) < 1e-5):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out + 0.0  # no -0


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of the rows, summed from the first component on, so that equal vectors get equal ones wherever they lie."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _rows(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as doubles, ends filled with zeros, and their lengths: -1 for a null one or one with a null component."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(int)
    flat, row = vectors.flatten(), np.repeat(np.arange(len(vectors)), size)
    out = np.zeros((len(vectors), max(size, default=0)))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    size[vectors.is_null().to_numpy(zero_copy_only=False)] = -1
    size[row[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    return out, size


#: Similarities held at once.
CELL = 1 << 21


def _best(queries: pa.Table, base: pa.Table, k: int) -> pa.Table:
    """query, key, similarity of each query's ``k`` best of the base rows: products of whole blocks find those near the k-th best, whose similarities are then summed one by one."""
    q, q_size = _rows(queries.column("query_vector"))
    b, b_size = _rows(base.column("vector"))
    width = max(q.shape[1], b.shape[1])
    q, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, b))
    both = pa.concat_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (queries.column("query"), base.column("key"))])
    code = pc.rank(both, tiebreaker="dense").to_numpy().astype(np.int64)  # keys by their order
    q_code, b_code = code[: len(q)], code[len(q) :]
    order = np.argsort(b_code, kind="stable")
    b, b_size, b_code = b[order], b_size[order], b_code[order]
    asked, found, near = [], [], []
    with np.errstate(all="ignore"):
        q_norm, b_norm = np.sqrt(_summed(q, q)), np.sqrt(_summed(b, b))
        unit = (b / np.where(b_norm == 0, 1, b_norm)[:, None]).T
        step = max(1, CELL // max(len(b), 1))
        for at in range(0, len(q), step):
            rows = slice(at, at + step)
            x = (q[rows] / np.where(q_norm[rows] == 0, 1, q_norm[rows])[:, None]) @ unit
            x[np.isnan(x)] = np.inf  # as Spark orders them
            x[(q_size[rows, None] != b_size) & (q_norm[rows, None] != 0) & (b_norm != 0)] = -np.inf  # null
            x[(q_size[rows] < 0)[:, None] | (b_size < 0)] = -np.inf
            own = q_code[rows, None] == b_code
            x[own] = -np.inf
            least = np.partition(x, -k, axis=1)[:, -k] if len(b) > k else np.full(len(x), -np.inf)
            for i in range(len(x)):
                j = np.flatnonzero(((x[i] >= least[i] - 3e-6) | (x[i] == np.inf)) & ~own[i])
                if least[i] == -np.inf:  # of null ones the first by key do
                    null = j[x[i, j] == -np.inf][:k]
                    j = np.sort(np.concatenate([j[x[i, j] > -np.inf], null]))
                norm = q_norm[at + i] * b_norm[j]
                s = np.where(norm == 0, 0.0, _summed(np.broadcast_to(q[at + i], (len(j), width)), b[j]) / np.where(norm == 0, 1, norm))
                place = np.where(x[i, j] == -np.inf, -np.inf, np.where(np.isnan(s), np.inf, _half_up(s)))
                j, s, place = (v[(top := np.lexsort((j, -place))[:k])] for v in (j, s, place))
                asked.append(np.full(len(j), at + i))
                found.append(order[j])
                near.append(np.ma.array(s, mask=place == -np.inf))
    asked, found = (np.concatenate([*x, np.zeros(0, int)]).astype(int) for x in (asked, found))
    near = np.ma.concatenate([*near, np.ma.array(np.zeros(0))])
    return pa.table({"query": queries.column("query").take(pa.array(asked)), "key": base.column("key").take(pa.array(found)), "similarity": pa.array(near.data, mask=np.ma.getmaskarray(near))})


def cosine_neighbours(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int = 5) -> DataFrame:
    """For each stated query the ``k`` most similar other rows of ``base``; similarities to six places, ties to the smaller key, null ones (of vectors that are null or differ in length) last.

    Queries are dealt to blocks and base rows to shards, by hash; each block meets each shard in a task of its own,
    keeps its best ``k`` a query, and the shards' best are merged. No task holds more than a block and a shard, on
    average, and a fixed number of similarities.
    """
    ship(base.sparkSession)
    n = base.count()
    blocks, shards = max(1, -(-queries.count() // BLOCK)), max(1, -(-n // SHARD), min(-(-n // LEAST), SHARDS))
    deal = lambda c, n, salt: F.pmod(F.xxhash64(F.lit(salt), c), F.lit(n)).cast("int")
    lay = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.where(F.col(key).isNotNull()).select(F.col(key).alias("query"), F.col(vector).alias("query_vector"), deal(F.col(key), blocks, 1).alias("block")).withColumn("shard", lay(shards))
    told = base.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector"), deal(F.col(key), shards, 0).alias("shard")).withColumn("block", lay(blocks))
    dealt = lambda df: df.repartition(blocks * shards, "block", "shard").groupBy("block", "shard")
    kind = base.schema[key].dataType.simpleString()
    met = dealt(asked).cogroup(dealt(told)).applyInArrow(lambda a, b: _best(a, b, k), f"query {kind}, key {kind}, similarity double")
    sims = met.select("query", F.col("key").alias(key), F.round("similarity", 6).alias("similarity"))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), key))
    return sims.withColumn("rank", best).where(F.col("rank") <= k).select("query", key, "similarity", "rank")


def fit_zipf(ranked: list[tuple[int, int]], rounds: int = 60) -> tuple[float, float, float, float]:
    """C, q, gamma, r2 of n = C / (rank + q)**gamma by least squares, q from 0 to 50 and gamma from .01 to 5.

    C is linear, so it follows from the others; those are found by damped Gauss-Newton steps from several starts, held
    within their bounds.
    """
    r, n = np.array(ranked, float).T
    lo, hi = np.array([0.0, 0.01]), np.array([50.0, 5.0])

    def at(p: np.ndarray) -> tuple[float, float, np.ndarray]:
        x = (r + p[0]) ** -p[1]
        c = max(float(x @ n / (x @ x)), 0.0)
        gap = n - c * x
        return float(gap @ gap), c, gap

    best = (np.inf, 0.0, np.array([0.0, 1.0]))
    for start in ((2.0, 1.0), (0.1, 0.5), (10.0, 1.5), (30.0, 3.0), (1.0, 2.5)):
        p, damp = np.array(start), 1e-3
        loss, c, gap = at(p)
        for _ in range(rounds):
            x = (r + p[0]) ** -p[1]
            slopes = np.stack([-p[1] * x / (r + p[0]), -x * np.log(r + p[0])], 1) * c
            slopes = slopes - np.outer(x, x @ slopes / (x @ x))  # what C does not take up
            a, g = slopes.T @ slopes, slopes.T @ gap
            free = ~(((p <= lo) & (g < 0)) | ((p >= hi) & (g > 0)))
            step = np.zeros(2)
            if free.any():
                own = a[np.ix_(free, free)]
                step[free] = np.linalg.solve(own + damp * np.diag(np.diag(own)) + 1e-30 * np.eye(len(own)), g[free])
            new = np.clip(p + step, lo, hi)
            after = at(new)
            if after[0] < loss:
                done = loss - after[0] <= 1e-14 * loss
                p, (loss, c, gap), damp = new, after, damp / 5
                if done:
                    break
            else:
                damp *= 5
                if damp > 1e9:
                    break
        if loss < best[0]:
            best = (loss, c, p)
    spread = float(((n - n.mean()) ** 2).sum())
    return best[1], float(best[2][0]), float(best[2][1]), 1 - best[0] / spread if spread else float("nan")


def zipf(corpus: DataFrame, *keys: str, counted: bool = False) -> DataFrame:
    """keys, c, q, gamma, r2: each corpus' rank-frequency fit; one group has the vocabulary's counts, already summed. ``counted``: given in place of the corpus (keys, sign, n)."""
    ship(corpus.sparkSession)
    u = corpus if counted else stats.unigrams(corpus, *keys)
    if not keys:
        u, keys = u.withColumn("all_", F.lit(0)), ("all_",)
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in u.select(*keys).schema.fields]

    def run(key, frame):
        import pandas as pd

        counts = sorted(frame["n"].tolist(), reverse=True)
        return pd.DataFrame([(*key, *fit_zipf(list(enumerate(counts, 1))))], columns=[*keys, "c", "q", "gamma", "r2"])

    return u.groupBy(*keys).applyInPandas(run, ", ".join(names) + ", c double, q double, gamma double, r2 double")


def zscore(features: DataFrame, names: list[str], *over: str) -> DataFrame:
    """Features less their mean, over their population deviation (1 where that is 0)."""
    w = Window.partitionBy(*over) if over else Window.partitionBy(F.lit(0))
    z = {n: (F.col(n) - F.avg(n).over(w)) / F.coalesce(F.nullif(F.stddev_pop(n).over(w), F.lit(0.0)), F.lit(1.0)) for n in names}
    return features.withColumns(z)


def nearest_centroid(features: DataFrame, names: list[str], query: str, label: str) -> DataFrame:
    """query, predicted, distance: for each row its nearest label by Euclidean distance to the labels' means, itself left out, after z-scores over all rows."""
    z = zscore(features, names)
    sums = z.groupBy(label).agg(F.count("*").alias("n_"), *[F.sum(n).alias(f"s_{n}") for n in names])
    grid = z.withColumnRenamed(label, "own_").join(F.broadcast(sums))
    own = F.col("own_") == F.col(label)
    left = F.col("n_") - own.cast("int")
    terms = [F.pow(F.col(n) - (F.col(f"s_{n}") - F.when(own, F.col(n)).otherwise(0.0)) / left, F.lit(2.0)) for n in names]
    d = grid.where(left > 0).withColumn("distance", F.sqrt(sum(terms[1:], terms[0])))
    ranked = d.withColumn("rank_", F.row_number().over(Window.partitionBy(query).orderBy("distance", label)))
    return ranked.where("rank_ = 1").select(query, F.col("own_").alias("actual"), F.col(label).alias("predicted"), "distance")
