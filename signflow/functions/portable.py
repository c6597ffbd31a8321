"""Randomness and statistics as column expressions, the same in every engine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signflow.session import discard, materialize, shared_dir


def hashed(*parts: Column | str | int) -> Column:
    """md5 of the parts joined by ``|``: an order that depends on keys alone."""
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def uniform(*parts: Column | str | int) -> Column:
    """A hashed number from 0 to 1."""
    return F.conv(F.substring(hashed(*parts), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


_TURNS = [n for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for n in row * 4]
_SINES = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]


#: The decimals of all numbers of one to four digits, as bytes of a word.
_DIGITS = [np.zeros(1, np.uint32), *(sum((np.arange(10**w) // 10 ** (w - 1 - i) % 10 + 48 << 8 * i) for i in range(w)).astype(np.uint32) for w in range(1, 5))]


def uniform_of(before: str, numbers: np.ndarray, after: str = "") -> np.ndarray:
    """``uniform`` of each text ``before`` number ``after``, for whole arrays inside a task."""
    return first_bits(before, numbers, after) / 4294967296.0


def first_bits(*parts: str | np.ndarray, block: int = 16384) -> np.ndarray:
    """The first 32 bits of md5 of each text (55 bytes at most) that the parts make, arrays by the decimals of their whole numbers from 0."""
    size = len(next(p for p in parts if not isinstance(p, str)))
    out = np.empty(size, np.uint32)
    for at in range(0, size, block):
        some = [p if isinstance(p, str) else p[at : at + block] for p in parts]
        widths = [np.searchsorted(10 ** np.arange(1, 20, dtype=np.uint64), x.astype(np.uint64), "right") + 1 for x in some if not isinstance(x, str) and len(str(x.min())) != len(str(x.max()))]
        if not widths:
            out[at : at + block] = _first_word(some)
            continue
        group = sum(w * 32**i for i, w in enumerate(widths))
        for g in np.unique(group):
            own = np.flatnonzero(group == g)
            out[at + own] = _first_word([x if isinstance(x, str) else x[own] for x in some])
    return out


def _laid(parts: list[str | np.ndarray]) -> list[int | np.ndarray]:
    """The sixteen words of a block that holds the text; the numbers of an array have as many digits each. Words that are the same for all are one number."""
    words: list[int | np.ndarray] = [0] * 16

    def put(at: int, x: int | np.ndarray, width: int) -> None:
        i, shift = at // 4, at % 4 * 8
        words[i] = words[i] | (x << shift if isinstance(x, np.ndarray) else x << shift & 0xFFFFFFFF)
        if shift + 8 * width > 32:
            words[i + 1] = words[i + 1] | x >> 32 - shift

    at = 0
    for p in parts:
        if isinstance(p, str):
            for byte in p.encode("ascii"):
                put(at, byte, 1)
                at += 1
            continue
        low, high = int(p.min()), int(p.max())
        rest, width = p.astype(np.uint32 if high < 2**32 else np.uint64), len(str(high))
        for done in range(0, width, 4):  # four digits a time, from the last
            w = min(4, width - done)
            if done and low == high:
                chunk = int(_DIGITS[w][low % 10**w])
            else:
                upper = rest // 10**w
                chunk, rest = _DIGITS[w][rest - upper * 10**w], upper
            put(at + width - done - w, chunk, w)
            low, high = low // 10**w, high // 10**w
        at += width
    put(at, 128, 1)
    words[14] = at * 8
    return words


def _first_word(parts: list[str | np.ndarray]) -> np.ndarray:
    """``first_bits`` of texts of one length. Steps before the first word that differs are taken once, and the last three, which don't reach the first 32 bits, not at all."""
    words = _laid(parts)
    a, b, c, d = 0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476
    begin = next(i for i, w in enumerate(words) if isinstance(w, np.ndarray))
    for i in range(begin):
        f = ((d ^ (b & (c ^ d))) + a + words[i] + _SINES[i]) & 0xFFFFFFFF
        a, d, c, b = d, c, b, b + (f << _TURNS[i] | f >> 32 - _TURNS[i]) & 0xFFFFFFFF
    size = len(words[begin])
    a, b, c, d = (np.full(size, v, np.uint32) for v in (a, b, c, d))
    f = np.empty(size, np.uint32)
    for i in range(begin, 61):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            g = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        a += f
        if isinstance(words[g], np.ndarray):
            a += words[g]
            a += np.uint32(_SINES[i])
        else:
            a += np.uint32(_SINES[i] + words[g] & 0xFFFFFFFF)
        np.left_shift(a, np.uint32(_TURNS[i]), out=f)
        a >>= np.uint32(32 - _TURNS[i])
        a |= f
        a += b
        a, d, c, b = d, c, b, a
    b += np.uint32(0x67452301)
    return b.byteswap()


def global_rank(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` with ``rank`` (bigint, from 0) over all rows, without gathering them: ranges, then ranks within each."""
    shared_dir(df.sparkSession)
    dealt = df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()).checkpoint()
    sizes = {r["range_"]: r["n"] for r in dealt.groupBy("range_").agg(F.count("*").alias("n")).collect()}  # one row for each partition
    before, at = [], 0
    for k in sorted(sizes):
        before.append((k, at))
        at += sizes[k]
    offsets = df.sparkSession.createDataFrame(before, "range_ int, before_ bigint")
    within = F.row_number().over(Window.partitionBy("range_").orderBy(*order)) - 1
    return dealt.withColumn("within_", within).join(F.broadcast(offsets), "range_").withColumn("rank", F.col("before_") + F.col("within_")).drop("range_", "within_", "before_")


def folds(df: DataFrame, k: int, seed: int = 0, *keys: str, written: bool = False) -> DataFrame:
    """``df`` with ``fold``: k equal ones (of each key's rows) by hashed order; the remainder gets -1 and is never held out.

    No row is moved: the last row of each fold is found among those whose hashes are near its share, and a row's fold is
    the number of such rows before it. ``df`` is read three times and so written first, unless it is ``written``. Where
    equal ids lie on both sides of a fold's end, rows are ranked.
    """
    if not written:
        df, _ = materialize(df, "rows")
    ends = _fold_ends(df, k, seed, *keys)
    if ends is None:
        return _ranked_folds(df, k, seed, *keys)
    placed = df.join(F.broadcast(ends), list(keys)) if keys else df.join(F.broadcast(ends))
    own = F.array(F.struct(hashed(seed, F.col("id")).alias("order_"), "id"))
    before = F.get(F.transform(own, lambda r: F.size(F.filter("ends_", lambda e: e < r))), F.lit(0))  # hashed once a row
    return placed.withColumn("fold", before).withColumn("fold", F.when(F.col("fold") < k, F.col("fold")).otherwise(-1)).drop("ends_")


def _fold_ends(df: DataFrame, k: int, seed: int, *keys: str, widths: float = 8.0) -> DataFrame | None:
    """keys, ends_: hash and id of each fold's last row; None where equal ids lie on both sides of one."""
    spark = df.sparkSession
    totals, path = materialize(df.groupBy(*keys).agg(F.count("*").alias("all_")).where("all_ > 0").withColumn("size_", F.greatest(F.floor(F.col("all_") / k), F.lit(1))).withColumn("folds_", F.least(F.lit(k), F.floor(F.col("all_") / F.col("size_")))), "totals")
    asked, most = totals.agg(F.coalesce(F.sum("folds_"), F.lit(0)), F.coalesce(F.max("all_"), F.lit(0))).first()
    with_totals = lambda x: x.join(F.broadcast(totals), list(keys)) if keys else x.join(F.broadcast(totals))
    hash_ = F.col("order_")
    at = F.conv(F.substring(hash_, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    while True:
        share = lambda j: j * F.col("size_") / F.col("all_")
        wide = lambda x, w=widths: w * F.sqrt(F.greatest(x * (1 - x), F.lit(0.0)) / F.col("all_")) + w * w / F.col("all_")
        each = F.sequence(F.lit(1), F.col("folds_").cast("int"))
        bounds = totals.select(*keys, F.transform(each, lambda j: share(j) - wide(share(j))).alias("low_"), F.transform(each, lambda j: share(j) + wide(share(j))).alias("high_"))
        rows = df.select(*keys, "id").withColumn("order_", hashed(seed, F.col("id")))
        rows = rows.join(F.broadcast(bounds), list(keys)) if keys else rows.join(F.broadcast(bounds))
        entered = lambda name, over: F.get(F.transform(F.array(at), lambda x: F.size(F.filter(name, lambda y: (y < x) if over else (y <= x)))), F.lit(0))
        rows = rows.select(*keys, "id", "order_", entered("low_", False).alias("in_"), entered("high_", True).alias("out_"))
        near = F.col("in_") > F.col("out_")  # within the bounds of an end; a row for all between
        counted, counted_path = materialize(rows.groupBy(*keys, (F.col("in_") + F.col("out_")).alias("place_"), F.when(near, hash_).alias("order_"), F.when(near, F.col("id")).alias("id")).agg(F.count("*").alias("here_"), F.first(near).alias("near_")), "near")
        upto = F.sum("here_").over(Window.partitionBy(*keys).orderBy("place_", "order_", "id").rowsBetween(Window.unboundedPreceding, 0))
        ranked = with_totals(counted.withColumn("upto_", upto)).where("near_")
        first, last = F.floor((F.col("upto_") - F.col("here_")) / F.col("size_")) + 1, F.floor(F.col("upto_") / F.col("size_"))
        ended = ranked.where((last >= first) & (first <= F.col("folds_")))
        found, found_path = materialize(ended.select(*keys, "order_", "id", "here_", (F.col("upto_") == first * F.col("size_")).alias("clean_")), "ends")
        n, torn = found.agg(F.count("*"), F.count_if(~F.col("clean_"))).first()
        discard(spark, counted_path)
        if torn or n == asked or widths * widths > most:
            out = None if torn or n != asked else materialize(found.groupBy(*keys).agg(F.collect_list(F.struct("order_", "id")).alias("ends_")) if asked else found.select(*keys, F.array(F.struct("order_", "id")).alias("ends_")), "ends")[0]
            discard(spark, path, found_path)
            return out
        discard(spark, found_path)
        widths *= 4


def _ranked_folds(df: DataFrame, k: int, seed: int, *keys: str) -> DataFrame:
    """``folds`` from a rank over all rows."""
    ranked = global_rank(df.withColumn("order_", hashed(seed, F.col("id"))), *keys, "order_", "id")
    if keys:
        sizes = ranked.groupBy(*keys).agg(F.min("rank").alias("first_"), F.greatest(F.floor(F.count("*") / k), F.lit(1)).alias("size_"))
        ranked, at, size = ranked.join(F.broadcast(sizes), list(keys)), F.col("rank") - F.col("first_"), F.col("size_")
    else:
        at, size = F.col("rank"), F.lit(max(1, df.count() // k))
    return ranked.withColumn("fold", F.when(at < k * size, F.floor(at / size)).otherwise(-1).cast("int")).drop("rank", "order_", "first_", "size_")


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson's interval of a share, within 0 and 1; null for n = 0."""
    p = F.try_divide(hits.cast("double"), n)
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n))
    width = 1 + F.lit(z * z) / n
    return F.greatest((mid - half) / width, F.lit(0.0)), F.least((mid + half) / width, F.lit(1.0))
