"""Null corpora: shuffles and models that keep some statistics and destroy others. Randomness is hashed, so runs repeat."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signflow.functions.portable import first_bits, global_rank, hashed, uniform, uniform_of
from signflow.operators.tokens import counted, pairs, tokens
from signflow.session import discard, materialize, ship

#: Rows that a marginal table may have to be broadcast.
SMALL = 200_000


def within_shuffle(corpus: DataFrame, seed: int = 0) -> DataFrame:
    """Each row's signs in hashed order, inside the row."""
    keyed = F.transform("signs", lambda s, i: F.struct(hashed(seed, F.col("id"), i).alias("k"), i.alias("i"), s.alias("s")))
    return corpus.withColumn("signs", F.transform(F.array_sort(keyed), lambda x: x["s"]))


def position_preserving_shuffle(corpus: DataFrame, seed: int = 0) -> DataFrame:
    """The same, but the first and last sign stay."""
    n = F.size("signs")
    key = lambda i: F.when(i == 0, "").when(i == n - 1, "~").otherwise(hashed(seed, F.col("id"), i))
    keyed = F.transform("signs", lambda s, i: F.struct(key(i).alias("k"), i.alias("i"), s.alias("s")))
    return corpus.withColumn("signs", F.when(n > 2, F.transform(F.array_sort(keyed), lambda x: x["s"])).otherwise(F.col("signs")))


def global_shuffle(corpus: DataFrame, seed: int = 0) -> DataFrame:
    """All tokens permuted over all places; lengths stay. Both rankings are made by ranges, never in one task."""
    t = tokens(corpus)
    places = global_rank(t.select("id", "pos"), "id", "pos")
    signs = global_rank(t.select("sign", hashed(seed, F.col("id"), F.col("pos")).alias("k"), F.col("id").alias("from_"), F.col("pos").alias("at_")), "k", "from_", "at_")
    rows = places.join(signs.select("rank", "sign"), "rank").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sign"))), lambda x: x["sign"]).alias("signs"))
    return rows


def cuts(corpus: DataFrame, trials: int, seed: int = 0, n: int | None = None, fraction: float | None = None, keys: tuple[str, ...] = (), widths: float = 8.0) -> DataFrame:
    """keys, trial, cut: the largest hash of the rows that a trial takes, ``n`` or a ``fraction`` (at least one row) of each key's rows; all, if fewer.

    The cut's place among even hashes is known to some deviations (``widths``): those below are counted, and only the
    few within are kept and ranked. Where a cut is not among them the rows are read again, four times as wide.
    """
    spark, trial = corpus.sparkSession, F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial")
    want = F.lit(n) if fraction is None else F.greatest(F.lit(1), F.rint(F.col("all_") * fraction))
    totals, path = materialize(corpus.groupBy(*keys).agg(F.count("*").alias("all_")).where("all_ > 0").withColumn("want_", F.least(want, F.col("all_")).cast("bigint")).where("want_ > 0"), "totals")
    asked = totals.count() * trials
    by, share = [*keys, "trial"], F.col("want_") / F.col("all_")
    while True:
        wide = widths * F.sqrt(share * (1 - share) / F.col("all_")) + widths * widths / F.col("all_")
        bounds = totals.select(*keys, (share - wide).alias("low_"), (share + wide).alias("high_"))
        near = corpus.select(*keys, "id").join(F.broadcast(bounds), list(keys)) if keys else corpus.select("id").join(F.broadcast(bounds))
        near = near.select(*keys, "low_", "high_", "id", trial).select(*keys, "trial", "low_", "high_", hashed(F.col("trial"), seed, F.col("id")).alias("order_")).withColumn("at_", F.conv(F.substring("order_", 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0))
        counted_, near_path = materialize(near.where("at_ <= high_").groupBy(*by, F.when(F.col("at_") >= F.col("low_"), F.col("order_")).alias("order_")).agg(F.count("*").alias("here_")), "near")  # a row for all below
        upto = F.sum("here_").over(Window.partitionBy(*by).orderBy(F.asc_nulls_first("order_")).rowsBetween(Window.unboundedPreceding, 0))
        ranked = counted_.withColumn("upto_", upto)
        ranked = ranked.join(F.broadcast(totals.select(*keys, "want_")), list(keys)) if keys else ranked.join(F.broadcast(totals.select("want_")))
        found, _ = materialize(ranked.where("order_ is not null and upto_ >= want_ and upto_ - here_ < want_").select(*by, F.col("order_").alias("cut")), "cuts")
        discard(spark, near_path)
        if found.count() == asked:
            discard(spark, path)
            return found
        widths *= 4


def subsample(corpus: DataFrame, n: int | None = None, trials: int = 1, seed: int = 0, fraction: float | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """``n`` rows (or a ``fraction``, of each key's rows) of each trial without replacement: those first in hashed order. Rows of one id stay together.

    Where all trials together take no more rows than there are, the rows that a trial may take are written as they are
    hashed and its cut found among them, so that the corpus is read, and each row hashed for each trial, only once more.
    """
    spark, by = corpus.sparkSession, [*keys, "trial"]
    order = hashed(F.col("trial"), seed, F.col("id"))
    fanned = corpus.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    sizes, path = materialize(corpus.groupBy(*keys).agg(F.count("*").alias("all_")), "sizes")
    r = sizes.agg(F.coalesce(F.sum("all_"), F.lit(0)).alias("all_"), F.coalesce(F.sum(F.least("all_", F.lit(n))), F.lit(0)).alias("want_")).first() if n else None
    widths = 8.0
    while n and 0 < r["want_"] * trials <= r["all_"]:
        share = F.least(F.lit(n), F.col("all_")) / F.col("all_")
        most = share + widths * F.sqrt(share * (1 - share) / F.col("all_")) + widths * widths / F.col("all_")
        text = F.lower(F.lpad(F.hex(F.floor(most * 4294967296).cast("bigint")), 8, "0"))
        high = sizes.select(*keys, F.when(most < 1, F.concat(text, F.lit("g"))).otherwise("g").alias("high_"))  # after all hashes that begin so
        rows = fanned.join(F.broadcast(high), list(keys)) if keys else fanned.join(F.broadcast(high))
        rows = rows.withColumn("order_", order).where("order_ <= high_")
        taken, _ = materialize(rows.select(*corpus.columns, "trial", "order_"), "taken")
        asked = sizes.select(*keys, F.least(F.lit(n), F.col("all_")).alias("want_"))
        upto = F.sum("here_").over(Window.partitionBy(*by).orderBy("order_").rowsBetween(Window.unboundedPreceding, 0))
        ranked = taken.groupBy(*by, "order_").agg(F.count("*").alias("here_")).withColumn("upto_", upto)
        ranked = ranked.join(F.broadcast(asked), list(keys)) if keys else ranked.join(F.broadcast(asked))
        table, table_path = materialize(ranked.where("upto_ >= want_ and upto_ - here_ < want_").select(*by, F.col("order_").alias("cut")), "cuts")
        if table.count() == (sizes.where(reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])) if keys else sizes).count() * trials:
            discard(spark, path)
            return taken.join(F.broadcast(table), by).where("order_ <= cut").select(*corpus.columns, "trial")
        discard(spark, table_path)
        widths *= 4
    discard(spark, path)
    table = cuts(corpus, trials, seed, n, fraction, keys)  # a row for each trial and key
    return fanned.join(F.broadcast(table), by).where(order <= F.col("cut")).select(*corpus.columns, "trial")


def intervals(counts: DataFrame, *keys: str) -> DataFrame:
    """keys, sign, lo, hi, total, kinds: the counts ``n`` of the signs laid end to end, for drawing. Windows hold a vocabulary."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    hi = F.sum("n").over(w.orderBy("sign").rowsBetween(Window.unboundedPreceding, 0))
    return counts.select(*keys, "sign", (hi - F.col("n")).alias("lo"), hi.alias("hi"), F.sum("n").over(w).alias("total"), F.count("*").over(w).alias("kinds"))


@dataclass
class Urn:
    """Intervals ready to draw from: ``pieces`` of them, and by key the ``sizes``, broadcast where there are few."""

    pieces: DataFrame
    sizes: DataFrame
    keys: list[str]
    few: bool

    def draw(self, rows: DataFrame, u: str, out: str) -> DataFrame:
        """``rows`` with ``out``: the sign in whose interval the number ``u`` times the total lies; null for keys without a table."""
        keys, sizes = self.keys, F.broadcast(self.sizes) if self.few else self.sizes
        asked = rows.join(sizes, keys, "left") if keys else rows.join(sizes)
        asked = asked.withColumn("at_", F.floor(F.col(u) * F.col("total_"))).withColumn("piece_", F.floor(F.col("at_") / F.col("width_")))
        inside = [F.col(f"r.{k}") == F.col(f"t.{k}") for k in keys] + [F.col("r.piece_") == F.col("t.piece_"), F.col("r.at_") >= F.col("t.lo"), F.col("r.at_") < F.col("t.hi")]
        met = asked.alias("r").join(self.pieces.alias("t"), inside, "left")
        return met.select(*[F.col(f"r.`{c}`") for c in rows.columns], F.col("t.sign").alias(out))


def urn(table: DataFrame, keys: list[str], few: bool = True) -> Urn:
    """An urn of ``intervals``; ``few``: whether the keys are so few that their sizes may be broadcast.

    Intervals are cut at multiples of a width that makes about twice as many pieces as there are signs, and rows meet
    those of their own piece by an equi-join, so neither a vocabulary nor a packed array travels with a row.
    """
    t = table.withColumn("width_", F.floor(F.col("total") / (2 * F.col("kinds"))) + 1)
    sizes = t.groupBy(*keys).agg(F.first("total").alias("total_"), F.first("width_").alias("width_"))
    piece = F.explode(F.sequence(F.floor(F.col("lo") / F.col("width_")), F.floor((F.col("hi") - 1) / F.col("width_"))))
    return Urn(t.select(*keys, "sign", "lo", "hi", piece.alias("piece_")), sizes, keys, few)


def draw(rows: DataFrame, u: str, table: DataFrame, keys: list[str], out: str) -> DataFrame:
    """``rows`` with ``out``, drawn from a table of few keys."""
    return urn(table, keys).draw(rows, u, out)


def matched_null(corpus: DataFrame, n: int, seed: int = 0, stratum: Column | None = None, least: int = 20, trials: int = 1, most: int = SMALL) -> DataFrame:
    """trial, id, signs, stratum: ``n`` rows of each trial whose lengths, first, middle and last signs are drawn independently from the corpus' own.

    With ``stratum`` (a string expression) each stratum has its own marginals, those of under ``least`` rows share
    the pooled ones. All trials are one job; rows are numbered through them. Marginal tables of up to ``most`` entries
    go to the tasks, which draw whole rows, many at a time; larger ones are drawn from by joins, with the same result.
    """
    spark = corpus.sparkSession
    given = corpus.where(F.size("signs") > 0).select("signs", (F.lit("all") if stratum is None else stratum).alias("stratum"))
    if given.schema["stratum"].dataType.simpleString() == "string":
        pair = lambda kind, sign: F.struct(F.lit(kind).alias("kind"), sign.alias("sign"))
        told = F.concat(F.array(pair("length", F.lpad(F.size("signs").cast("string"), 6, "0")), pair("first", F.element_at("signs", 1))), F.transform("signs", lambda x: pair("any", x)), F.when(F.size("signs") > 1, F.array(pair("last", F.element_at("signs", -1)))).otherwise(F.array().cast("array<struct<kind:string,sign:string>>")))
        counts, path = materialize(counted(given.select("stratum", F.inline(told)), "stratum", "kind", "sign"), "marginals")
        few = counts.count() <= most
        rows = [(r["stratum"], r["kind"], r["sign"], r["n"]) for r in counts.collect()] if few else []
        discard(spark, path)
        if few:
            ship(spark)
            drawn = spark.range(n * trials if rows else 0).mapInArrow(_matched_rows(seed, rows, least), "k bigint, signs array<string>, stratum string")
            return drawn.select(F.floor(F.col("k") / n).cast("int").alias("trial"), F.format_string("NULL-%05d", "k").alias("id"), "signs", "stratum")
    c = corpus.where(F.size("signs") > 0).select("signs", (F.lit("all") if stratum is None else stratum).alias("stratum"))
    sizes = counted(c, "stratum").withColumn("source", F.when(F.col("n") >= least, F.col("stratum")).otherwise("__pooled__"))
    pooled = c.select("signs", F.lit("__pooled__").alias("source"))
    c = c.select("signs", F.col("stratum").alias("source")).unionByName(pooled)
    marginal = lambda e, rows: intervals(counted(rows.select("source", e.alias("sign")), "source", "sign"), "source")
    lengths = marginal(F.lpad(F.size("signs").cast("string"), 6, "0"), c)
    first, last = marginal(F.element_at("signs", 1), c), marginal(F.element_at("signs", -1), c.where(F.size("signs") > 1))
    every = marginal(F.explode("signs"), c)
    rows = corpus.sparkSession.range(n * trials).withColumnRenamed("id", "k").withColumn("u0", uniform(seed, "stratum", F.col("k"))).withColumn("u1", uniform(seed, "length", F.col("k")))
    strata = intervals(sizes.select(F.col("stratum").alias("sign"), "n"))
    rows = draw(rows, "u0", strata, [], "stratum").join(F.broadcast(sizes.select("stratum", "source")), "stratum")
    rows = draw(rows, "u1", lengths, ["source"], "length").withColumn("length", F.col("length").cast("int"))
    spots = rows.select("k", "stratum", "source", "length", F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("pos")).withColumn("u", uniform(seed, "sign", F.col("k"), F.col("pos")))
    ends = (F.col("pos") == 0, F.col("pos") == F.col("length") - 1)
    a = draw(spots.where(ends[0]), "u", first, ["source"], "sign")
    z = draw(spots.where(~ends[0] & ends[1]), "u", last, ["source"], "sign")
    m = draw(spots.where(~ends[0] & ~ends[1]), "u", every, ["source"], "sign")
    built = a.unionByName(z).unionByName(m).groupBy("k", "stratum").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sign"))), lambda x: x["sign"]).alias("signs"))
    return built.select(F.floor(F.col("k") / n).cast("int").alias("trial"), F.format_string("NULL-%05d", "k").alias("id"), "signs", "stratum")


def _matched_rows(seed: int, counts: list[tuple[str | None, str, str | None, int]], least: int):
    """A task's step from row numbers to k, signs, stratum of ``matched_null``, by the ``counts`` (stratum, kind, sign, n) of its marginals."""
    first = lambda x: (x is not None, x or "")  # noqa: E731  as Spark orders them
    sizes: dict[str | None, int] = {}
    for s, kind, _, m in counts:
        sizes[s] = sizes.get(s, 0) + (m if kind == "length" else 0)
    strata = sorted(sizes, key=first)
    pooled = len(strata)
    source = np.array([i if sizes[s] >= least else pooled for i, s in enumerate(strata)], np.int64)
    signs = sorted({x for _, kind, x, _ in counts if kind != "length"}, key=first)
    number, place = {x: i for i, x in enumerate(signs)}, {s: i for i, s in enumerate(strata)}
    tables: dict[str, dict[tuple[int, str | None], int]] = {k: {} for k in ("length", "first", "last", "any")}
    for s, kind, x, m in counts:
        for at in (place[s], pooled):
            tables[kind][at, x] = tables[kind].get((at, x), 0) + m
    laid = {}
    for kind, table in tables.items():  # all sources end to end
        entries = sorted(table.items(), key=lambda e: (e[0][0], first(e[0][1])))
        m = np.array([n for _, n in entries], np.int64)
        total = np.bincount([at for (at, _), _ in entries], m, pooled + 1).astype(np.int64) if entries else np.zeros(pooled + 1, np.int64)
        laid[kind] = np.array([int(x) if kind == "length" else number[x] for (_, x), _ in entries], np.int64), np.cumsum(m), total, np.cumsum(total) - total
    ends = np.cumsum([sizes[s] for s in strata])

    def draw(kind: str, of: np.ndarray, u: np.ndarray) -> np.ndarray:
        values, upto, total, start = laid[kind]
        return values[np.searchsorted(upto, start[of] + np.floor(u * total[of]).astype(np.int64), "right")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, labels = pa.array(signs, pa.string()), pa.array(strata, pa.string())
        for batch in batches:
            k = batch.column(0).to_numpy()
            own = np.searchsorted(ends, np.floor(uniform_of(f"{seed}|stratum|", k) * ends[-1]), "right")
            if strata[0] is None:
                k, own = k[own > 0], own[own > 0]
            of = source[own]
            size = draw("length", of, uniform_of(f"{seed}|length|", k))
            order = np.argsort(-size, kind="stable")
            k, own, of, size = k[order], own[order], of[order], size[order]
            start = np.cumsum(size) - size
            drawn = np.empty(int(size.sum()), np.int64)
            for pos in range(int(size.max(initial=0))):
                m = int(np.searchsorted(-size, -pos, "left"))  # rows longer than pos
                on = int(np.searchsorted(-size, -pos - 1, "left"))  # and those that go on
                u = uniform_of(f"{seed}|sign|", k[:m], f"|{pos}")
                for kind, some in ((("first", slice(0, m)),) if pos == 0 else (("any", slice(0, on)), ("last", slice(on, m)))):
                    drawn[start[some] + pos] = draw(kind, of[some], u[some])
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(drawn)).astype(np.int32)), names.take(pa.array(drawn)))
            yield pa.RecordBatch.from_arrays([pa.array(k), lists, labels.take(pa.array(own))], ["k", "signs", "stratum"])

    return run


END = "<END>"
#: Steps of chains between writes.
STEPS = 4


def markov_null(corpus: DataFrame, n: int, order: int = 1, seed: int = 0, longest: int = 40, paired: float = 0.9) -> DataFrame:
    """id, signs: ``n`` rows from a Markov chain with a learned end, of order 1 or 2.

    All chains go on together, a sign a step: those that have not ended meet the transitions of their last signs by
    joins. Every ``STEPS`` steps (each step, if tables are too large to be broadcast) what has ended leaves and the rest
    is written, which cuts lineage. At order 2 a share ``paired`` of the chains begins with the
    first two signs of a row, the others with one sign; two signs without transitions of their own go on as the last
    alone does. Tables of transitions may be of any size. Without rows to learn from there are no chains.
    """
    if order not in (1, 2):
        raise ValueError("order is 1 or 2")
    spark, temporary = corpus.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        df, path = materialize(df, name)
        temporary.append(path)
        return df

    def prepared(counts: DataFrame, *keys: str) -> Urn:
        made = urn(kept(intervals(counts, *keys), "intervals"), list(keys))
        sizes, pieces = kept(made.sizes, "sizes"), kept(made.pieces, "pieces")
        few = sizes.count() <= SMALL and pieces.count() <= SMALL
        return Urn(F.broadcast(pieces) if few else pieces, sizes, list(keys), few)

    rows = corpus.where(F.size("signs") > 0)
    ended = rows.withColumn("signs", F.concat("signs", F.array(F.lit(END))))
    urns = [prepared(counted(pairs(ended).select(F.col("a").alias("c1"), F.col("b").alias("sign")), "c1", "sign"), "c1")]
    first = prepared(counted(rows.select(F.element_at("signs", 1).alias("sign")), "sign"))
    chains = spark.range(n).select(F.col("id").alias("k"), uniform(seed, "first", F.col("id")).alias("u"))
    s, nothing = F.col("signs"), F.lit(None).cast("string")
    if order == 2:
        three = F.transform(F.sequence(F.lit(1), F.size(s) - 2), lambda i: F.struct(F.element_at(s, i).alias("c2"), F.element_at(s, i + 1).alias("c1"), F.element_at(s, i + 2).alias("sign")))
        urns.insert(0, prepared(counted(ended.where(F.size(s) > 2).select(F.inline(three)), "c2", "c1", "sign"), "c2", "c1"))
        first_two = prepared(counted(rows.where(F.size(s) > 1).select(F.concat_ws("\x1f", F.element_at(s, 1), F.element_at(s, 2)).alias("sign")), "sign"))
        by_two = (uniform(seed, "paired", F.col("k")) < paired) & F.lit(first_two.sizes.count() > 0)
        pair = first_two.draw(chains.where(by_two).withColumn("u", uniform(seed, "pair", F.col("k"))), "u", "sign")
        state = first.draw(chains.where(~by_two), "u", "sign").unionByName(pair)
    else:
        state = first.draw(chains, "u", "sign")
    state = state.where("sign is not null").select("k", F.split("sign", "\x1f").alias("signs"))
    state = kept(state.select("k", "signs", F.when(F.size("signs") > 1, F.element_at("signs", -2)).alias("c2"), F.element_at("signs", -1).alias("c1")), "chains")

    def step(df: DataFrame) -> DataFrame:
        df = df.withColumn("u", uniform(seed, "step", F.col("k"), F.size("signs")))
        for i, made in enumerate(urns):
            df = made.draw(df, "u", f"sign{i}")
        df = df.withColumn("sign", F.coalesce(*[f"sign{i}" for i in range(len(urns))]))
        goes = F.col("sign").isNotNull() & (F.col("sign") != END)
        df = df.select("k", F.when(goes, F.concat("signs", F.array("sign"))).otherwise(F.col("signs")).alias("signs"), (F.when(F.col("sign").isNotNull(), F.col("c1")).otherwise(F.col("c2")) if order == 2 else nothing).alias("c2"), F.coalesce("sign", "c1").alias("c1"))
        return df.withColumn("c1", F.when(F.size("signs") >= longest, F.lit(END)).otherwise(F.col("c1")))

    at_once = STEPS if all(x.few for x in urns) else 1
    done = []
    while state.limit(1).count():
        for _ in range(at_once):
            state = step(state)
        state = kept(state, "chains")
        done.append(state.where(F.col("c1") == END))
        state = state.where(F.col("c1") != END)
    every = reduce(DataFrame.unionByName, done) if done else state
    out, _ = materialize(every.select(F.format_string("MARKOV-%05d", "k").alias("id"), "signs"), "markov")
    discard(spark, *temporary)
    return out


#: Rows of a trial that one task draws at a time; a larger trial is drawn in parts, whose distinct rows then meet.
PART = 1 << 24
#: Rows of a length that there may be for those that were drawn to be marked in a table; of others, numbers are sorted.
MARKS = 1 << 24
#: Signs that are drawn together, about.
TOGETHER = 1 << 18


def _drawn_parts(seed: int, table: dict[str, list[tuple[int, int]]], signs: int, n: int, parts: int):
    """A task's step from numbers of parts to how many distinct rows (of those that ``matched_null`` draws) a trial's only part holds, or to the rows themselves, packed by length and bucket.

    A row of up to 62 bits is one number by its signs, a longer one 128 bits of hash. A length all of whose possible
    rows have been drawn is drawn no more.
    """
    laid = {k: _laid_out(x) for k, x in table.items() if x}
    exact = int(62 / np.log2(max(signs, 2)))  # signs that fit in one number
    total = sum(m for _, m in table["length"])
    longest = max(size for size, _ in table["length"])
    step = max(1, min(1 << 16, TOGETHER * total // sum(size * m for size, m in table["length"])))
    possible = lambda size: len(table["first"]) * (len(table["any"]) ** (size - 2) * len(table["last"]) if size > 1 else 1)

    def draw(kind: str, bits: np.ndarray) -> np.ndarray:
        ids, bounds, guide = laid[kind]
        got = guide[bits >> np.uint32(GUIDE)]
        unsure = np.flatnonzero(got < 0)
        got[unsure] = ids[np.searchsorted(bounds, bits[unsure].astype(np.int64), "right")]
        return got

    def mixed(h: np.ndarray, x: np.ndarray, by: int) -> np.ndarray:
        h = (h ^ x) * np.uint64(by)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    def rows(k: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By row, longest first: the number of a short one, two hashes of a long one."""
        place = np.arange(longest)
        more = len(size) - np.searchsorted(size[::-1], place, "right")  # rows longer than each place
        place, more = place[more > 0], more[more > 0]
        bits = first_bits(f"{seed}|sign|", np.concatenate([k[:m] for m in more]), "|", np.repeat(place, more))
        long = int(np.searchsorted(-size, -exact, "left"))
        code, h = np.zeros(len(k), np.int64), np.zeros((2, long), np.uint64)
        at = 0
        for pos, m in enumerate(more):
            own, at = bits[at : at + m], at + m
            on = more[pos + 1] if pos + 1 < len(more) else 0  # rows that go on
            x = draw("first", own) if not pos else np.concatenate([draw("any", own[:on]), draw("last", own[on:])]) if on < m else draw("any", own)
            if m > long:
                code[long:m] *= signs
                code[long:m] += x[long:]
            if long:
                y, m = (x[:long] + 1).astype(np.uint64), min(m, long)
                h[0, :m], h[1, :m] = mixed(h[0, :m] + np.uint64(1), y, 0x9E3779B97F4A7C15), mixed(h[1, :m] + np.uint64(7), y, 0xD6E8FEB86659FD93)
        return code, h

    def distinct(start: int, stop: int) -> Iterator[tuple[int, np.ndarray]]:
        """Length (0: all long ones) and distinct rows, in order, of those that the numbers from ``start`` draw."""
        marked, full, drawn, rest = {}, np.zeros(longest + 1, bool), {}, {}
        every = np.array([size for size, _ in table["length"]])
        for at in range(start, stop, step):
            if full[every].all():
                break
            k = np.arange(at, min(at + step, stop))
            size = draw("length", first_bits(f"{seed}|length|", k))
            if full.any():
                left = ~full[size]
                k, size = k[left], size[left]
                if not len(k):
                    continue
            order = np.argsort((longest - size).astype(np.uint16 if longest < 1 << 16 else np.int64), kind="stable")
            k, size = k[order], size[order]
            code, h = rows(k, size)
            if h.shape[1]:
                rest.setdefault(0, []).append(h.view(np.int64))
            ends = np.append(np.flatnonzero(np.diff(size)) + 1, len(size))
            for i, j in zip([0, *ends[:-1]], ends):
                length = int(size[i])
                if length > exact:
                    continue
                drawn[length] = drawn.get(length, 0) + int(j - i)
                if signs**length <= min(MARKS, 8 * (stop - start)):
                    if length not in marked:
                        marked[length] = np.zeros(signs**length, bool)
                    marked[length][code[i:j]] = True
                    if drawn[length] >= possible(length):
                        full[length] = np.count_nonzero(marked[length]) == possible(length)
                else:
                    rest.setdefault(length, []).append(code[i:j].copy())
        for length, marks in marked.items():
            yield length, np.flatnonzero(marks)
        for length in list(rest):
            yield length, _distinct(rest.pop(length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                trial, part = divmod(part, parts)
                found = distinct(trial * n + part * n // parts, trial * n + (part + 1) * n // parts)
                if parts == 1:
                    yield pa.RecordBatch.from_pylist([{"trial": trial, "length": None, "bucket": None, "n_distinct": sum(x.shape[-1] for _, x in found), "rows": None}], PACKED)
                    continue
                for length, x in found:
                    bucket = ((x if length else x[0]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(4 * parts)
                    for i in np.unique(bucket).tolist():
                        yield pa.RecordBatch.from_pylist([{"trial": trial, "length": length, "bucket": i, "n_distinct": None, "rows": _packed(x[..., bucket == i])}], PACKED)

    return run


#: Bits below those that the guide of a table goes by.
GUIDE = 18
PACKED = pa.schema([("trial", pa.int32()), ("length", pa.int32()), ("bucket", pa.int32()), ("n_distinct", pa.int64()), ("rows", pa.binary())])


def _laid_out(table: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids; the least 32 bits from which each next one is drawn; by the upper bits the id that all of them draw, or -1. ``table``: id, n."""
    ids, ends = np.array([i for i, _ in table], np.int64), np.cumsum([m for _, m in table])
    low, high = np.zeros(len(ids), np.int64), np.full(len(ids), 1 << 32, np.int64)
    while (low < high).any():  # the product is rounded, as SQL's is, but never falls
        mid = (low + high) // 2
        reached = np.floor(mid / 4294967296.0 * ends[-1]) >= ends
        low, high = np.where(reached, low, mid + 1), np.where(reached, mid, high)
    bounds = low[:-1]
    starts = np.arange(1 << 32 - GUIDE, dtype=np.int64) << GUIDE
    first, last = (np.searchsorted(bounds, x, "right") for x in (starts, starts + (1 << GUIDE) - 1))
    return ids, bounds, np.where(first == last, ids[first], -1)


def _distinct(found: list[np.ndarray]) -> np.ndarray:
    """The distinct numbers, or pairs of hashes (two lines), in order."""
    x = np.concatenate(found, -1)
    found.clear()
    if x.ndim == 1:
        x.sort()
        return x[np.append(True, x[1:] != x[:-1])]
    x = x[:, np.lexsort(x[::-1])]
    return x[:, np.append(True, (x[:, 1:] != x[:, :-1]).any(0))]


def _packed(x: np.ndarray) -> bytes:
    """Numbers in order as the bytes of their differences, all lowest bytes first, so that those above the highest are left out; hashes as they are."""
    if x.ndim > 1:
        return x.tobytes()
    apart = np.diff(x, prepend=0)
    width = (int(apart.max()).bit_length() + 7) // 8 or 1
    return bytes([width]) + apart.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(text: bytes, length: int) -> np.ndarray:
    if not length:
        return np.frombuffer(text, np.int64).reshape(2, -1)
    planes = np.frombuffer(text, np.uint8, offset=1).reshape(text[0], -1)
    apart = np.zeros((planes.shape[1], 8), np.uint8)
    apart[:, : text[0]] = planes.T
    return np.cumsum(apart.view("<i8").ravel())


def _met(key: tuple, rows: pa.Table) -> pa.Table:
    """trial, n_distinct of the rows of one trial, length and bucket, from all parts."""
    trial, length = key[0].as_py(), key[1].as_py()
    n = _distinct([_unpacked(x.as_py(), length) for x in rows.column("rows")]).shape[-1]
    return pa.table({"trial": pa.array([trial], pa.int32()), "n_distinct": pa.array([n], pa.int64())})


def matched_null_uniqueness(corpus: DataFrame, trials: int, n: int | None = None, seed: int = 0, most: int = SMALL, counts: DataFrame | None = None, part: int = PART) -> DataFrame:
    """trial, n_distinct, n, uniqueness of the rows that ``matched_null`` draws (without strata), ``n`` for each trial (None: as many as the corpus has).

    ``counts`` are the corpus' distinct rows with their numbers ``n``, where they are at hand. Marginal tables of up to
    ``most`` entries go to the tasks, which draw whole rows, many at a time, and find the distinct ones. Trials of up to
    ``part`` rows are counted where they are drawn; the distinct rows of larger ones are shuffled, packed. Larger tables
    are drawn from by joins, with the same result.
    """
    spark = corpus.sparkSession
    each = (counted(corpus.select("signs"), "signs") if counts is None else counts).where(F.size("signs") > 0)
    kinds = {"length": F.lpad(F.size("signs").cast("string"), 6, "0"), "first": F.element_at("signs", 1), "last": F.when(F.size("signs") > 1, F.element_at("signs", -1))}
    told = F.concat(F.array(*[F.struct(F.lit(k).alias("kind"), e.alias("sign")) for k, e in kinds.items()]), F.transform("signs", lambda x: F.struct(F.lit("any").alias("kind"), x.alias("sign"))))
    tables, path = materialize(each.select("n", F.inline(told)).where("sign is not null").groupBy("kind", "sign").agg(F.sum("n").alias("n")), "marginals")
    n = tables.where("kind = 'length'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] if n is None else n
    if not n:
        discard(spark, path)
        return spark.createDataFrame([], "trial int, n_distinct bigint, n bigint, uniqueness double")
    if tables.count() > most:
        drawn = matched_null(corpus, n, seed, trials=trials, most=most).select("trial", F.xxhash64("signs").alias("h1"), F.xxhash64(F.lit(1), "signs").alias("h2"))
        found = drawn.groupBy("trial", "h1", "h2").agg(F.lit(1).alias("n_distinct"))
    else:
        held: dict[str, list] = {k: [] for k in (*kinds, "any")}
        for r in tables.orderBy("kind", "sign").collect():
            held[r["kind"]].append((r["sign"], r["n"]))
        number = {s: i for i, s in enumerate(sorted({s for k in ("first", "last", "any") for s, _ in held[k]}))}
        table = {k: [(int(s) if k == "length" else number[s], m) for s, m in x] for k, x in held.items()}
        ship(spark)
        parts = -(-n // part)
        tasks = min(trials * parts, max(4 * spark.sparkContext.defaultParallelism, n * trials >> 20))
        found = spark.range(0, trials * parts, 1, tasks).mapInArrow(_drawn_parts(seed, table, len(number), n, parts), "trial int, length int, bucket int, n_distinct bigint, rows binary")
        if parts > 1:
            found = found.groupBy("trial", "length", "bucket").applyInArrow(_met, "trial int, n_distinct bigint")
    found = found.groupBy("trial").agg(F.sum("n_distinct").alias("n_distinct"))
    out, _ = materialize(found.select("trial", "n_distinct", F.lit(n).cast("bigint").alias("n"), (F.col("n_distinct") / n).alias("uniqueness")), "uniqueness")
    discard(spark, path)
    return out


def uniform_control(spark: SparkSession, vocab: int, n: int, mean: float, seed: int = 0) -> DataFrame:
    """``n`` rows of uniformly drawn signs; lengths are normal around ``mean`` (sd 1.5), at least 1."""
    u1, u2 = uniform(seed, "a", F.col("k")), uniform(seed, "b", F.col("k"))
    normal = F.sqrt(-2 * F.ln(F.greatest(u1, F.lit(1e-9)))) * F.cos(2 * np.pi * u2)
    rows = spark.range(n).withColumnRenamed("id", "k").withColumn("len", F.greatest(F.lit(1), F.round(mean + 1.5 * normal).cast("int")))
    sign = lambda i: F.concat(F.lit("R"), F.floor(uniform(seed, F.col("k"), i) * vocab).cast("string"))
    return rows.select(F.format_string("RAND-%05d", "k").alias("id"), F.transform(F.sequence(F.lit(1), F.col("len")), sign).alias("signs"))


def rigid_control(spark: SparkSession, vocab: int, n: int, mean: float, templates: int = 5, seed: int = 0) -> DataFrame:
    """``n`` rows, each one of a few fixed templates."""
    k = F.floor(uniform(seed, "t", F.col("k")) * templates).cast("int")
    sign = lambda i: F.concat(F.lit("F"), F.floor(uniform(seed, "f", F.col("t"), i) * vocab).cast("string"))
    rows = spark.range(n).withColumnRenamed("id", "k").withColumn("t", k)
    return rows.select(F.format_string("RIGID-%05d", "k").alias("id"), F.transform(F.sequence(F.lit(1), F.lit(max(1, round(mean)))), sign).alias("signs"))


def civilization(spark: SparkSession, kind: str, n: int, seed: int = 0) -> DataFrame:
    """Labelled synthetic corpora: ``a`` root, agreeing suffixes and a case marker; ``b`` administrative slots; ``c`` a mix of both with numerals; ``d`` a chain of order two; ``e`` category, sub-category and item, sometimes twice."""
    # The probabilities, numbers of kinds and prefixes below, and those of chain_of_two and demo_corpus
    k = F.col("k")
    u = lambda *p: uniform(seed, kind, k, *p)
    pick = lambda prefix, m, *p: F.concat(F.lit(prefix), F.floor(u(*p) * m).cast("string"))
    none = F.array().cast("array<string>")
    rows = spark.range(n).withColumnRenamed("id", "k")
    rows = rows.withColumns({"root_": F.floor(u("root") * 40), "n_": u("n"), "cat_": F.floor(u("cat", "1") * 4), "sub_": F.floor(u("sub", "1") * 3)})  # what is used more than once is a column, hashed once
    root = F.col("root_")
    suffix = lambda i: F.concat(F.lit("SFA"), F.when(u("agree", i) < 0.85, root % 4).otherwise(F.floor(u("pool", i) * 4)).cast("string"), F.lit("_"), F.floor(u("s", i) * 6).cast("string"))
    count = F.when(F.col("n_") < 0.2, 0).when(F.col("n_") < 0.75, 1).otherwise(2)
    a = F.concat(F.array(F.concat(F.lit("RTA"), root.cast("string"))), F.when(count == 0, none).when(count == 1, F.array(suffix("1"))).otherwise(F.array(suffix("1"), suffix("2"))), F.when(u("case") < 0.6, F.array(pick("CMA", 3, "marker"))).otherwise(none))
    b = F.concat(F.array(pick("CATB", 8, "cat")), F.when(u("loc?") < 0.7, F.array(pick("LOCB", 12, "loc"))).otherwise(none), F.when(u("aut?") < 0.5, F.array(pick("AUTB", 5, "aut"))).otherwise(none))
    rows = rows.withColumn("mixed_", F.when(u("mix") < 0.5, a).otherwise(b)).withColumn("at_", F.floor(u("at") * (F.size("mixed_") + 1)).cast("int"))
    mixed, at = F.col("mixed_"), F.col("at_")
    c = F.when(u("num?") < 0.3, F.concat(F.slice(mixed, F.lit(1), at), F.array(pick("NUMC", 9, "num")), F.slice(mixed, at + 1, F.size(mixed)))).otherwise(mixed)

    def triple(p: str) -> Column:
        cat, sub = (F.col("cat_"), F.col("sub_")) if p == "1" else (F.floor(u("cat", p) * 4), F.floor(u("sub", p) * 3))
        name = lambda *x: F.concat_ws("_", *[v.cast("string") for v in x])
        return F.array(F.concat(F.lit("CAT"), name(cat)), F.concat(F.lit("SUB"), name(cat, sub)), F.concat(F.lit("ITM"), name(cat, sub, F.floor(u("itm", p) * 6))))

    e = F.concat(triple("1"), F.when(u("twice") < 0.35, triple("2")).otherwise(none))
    d = chain_of_two(rows, u)
    return rows.select(F.format_string(f"CIV{kind.upper()}-%05d", "k").alias("id"), {"a": a, "b": b, "c": c, "d": d, "e": e}[kind].alias("signs"))


def normal(u1: Column, u2: Column) -> Column:
    """A normal number from two uniform ones."""
    return F.sqrt(-2 * F.ln(F.greatest(u1, F.lit(1e-9)))) * F.cos(2 * np.pi * u2)


#: Buckets of a number from 0 to 1, a power of two.
BUCKETS = 1024


def chosen(edges: list[float], u: Column) -> Column:
    """Which of the intervals that end at ``edges`` (rising) holds ``u``: of all edges, those of its bucket are looked through."""
    start = np.searchsorted(edges, np.arange(BUCKETS + 1) / BUCKETS, "right").tolist()
    constant = lambda x, kind: F.from_json(F.lit(str(x)), f"array<{kind}>")  # noqa: E731  parsed once
    bucket = F.floor(u * BUCKETS).cast("int")
    first, end = F.get(constant(start, "int"), bucket), F.get(constant(start, "int"), bucket + 1)
    passed = F.when(first == end, first).otherwise(first + F.size(F.filter(F.slice(constant(edges, "double"), first + 1, end - first), lambda x: x <= u)))
    return F.least(passed, F.lit(len(edges) - 1))


def chain_of_two(rows: DataFrame, u, signs: int = 40, special: int = 60, sure: float = 0.85) -> Column:
    """Order-2 rows: after one of ``special`` pairs mostly that pair's own sign, else any by a fixed weight."""
    rng = np.random.default_rng(4)
    pairs = rng.choice(signs * signs, special, replace=False).tolist()
    wanted = F.create_map(*[x for p, w in zip(pairs, rng.integers(0, signs, special).tolist(), strict=True) for x in (F.lit(p), F.lit(w))])
    weights = np.cumsum(rng.uniform(0.5, 1.5, signs))
    edges = (weights / weights[-1]).tolist()
    size = F.least(F.greatest(F.round(4.4 + 1.8 * normal(u("n1"), u("n2"))).cast("int"), F.lit(1)), F.lit(14))

    def grow(out: Column, i: Column) -> Column:
        before = F.get(out, i - 2) * signs + F.get(out, i - 1)
        own = F.when((i >= 2) & (u("sure", i) < sure), F.try_element_at(wanted, before))
        of = lambda x: F.when(i < 2, F.floor(x * signs).cast("int")).otherwise(chosen(edges, x))
        any_ = F.get(F.transform(F.array(u("any", i)), of), F.lit(0))  # hashed once
        return F.concat(out, F.array(F.coalesce(own, any_)))

    numbers = F.aggregate(F.sequence(F.lit(0), size - 1), F.array().cast("array<int>"), grow)
    return F.transform(numbers, lambda x: F.concat(F.lit("D"), x.cast("string")))


#: Sites and object types of the demo corpus. Fixed values.
SITES = ("Mohenjo-daro", "Harappa", "Lothal", "Dholavira", "Kalibangan")
TYPES = ("seal", "tablet", "pottery", "copper_plate", "ivory")


def demo_corpus(spark: SparkSession, n: int = 2000, signs: int = 120, seed: int = 42) -> DataFrame:
    """A corpus with known habits: Zipf-Mandelbrot signs, favoured first signs, a common last sign, doubling, strong successors, sites, types and damage."""
    rng = np.random.default_rng(seed)
    weights = np.cumsum(1 / (np.arange(1, signs + 1) + 2.7) ** 1.15)
    edges = (weights / weights[-1]).tolist()
    has = rng.random(signs) < 0.15
    strong = F.array(*[F.lit(int(w) if h else -1) for h, w in zip(has, rng.integers(0, signs, signs), strict=True)])
    k, size = F.col("k"), F.col("size_")
    u = lambda *p: uniform(seed, "demo", k, *p)
    length = F.least(F.greatest(F.round(4.4 + 2.0 * normal(u("n1"), u("n2"))).cast("int"), F.lit(1)), F.lit(26))
    first = F.when(u("first?") < 0.55, 2 + F.floor(u("first") * 3).cast("int")).otherwise(chosen(edges, u("first")))

    def grow(out: Column, i: Column) -> Column:
        after = F.get(strong, F.element_at(out, -1))
        middle = F.when((after >= 0) & (u("strong", i) < 0.8), after).otherwise(chosen(edges, u("any", i)))
        return F.when(i >= size - 1, out).otherwise(F.concat(out, F.array(middle)))

    numbers = F.aggregate(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), F.array(first), grow)
    favoured = F.when(u("double") < 0.33, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))  # the common last sign, itself doubled
    final = F.when(u("final") < 0.45, favoured).otherwise(F.array(chosen(edges, u("any", "final"))))
    numbers = F.when(size > 1, F.concat(numbers, final)).otherwise(numbers)
    of = lambda names, x: F.get(F.array(*map(F.lit, names)), F.floor(x * len(names)).cast("int"))
    names = F.array(*[F.lit(f"S{x + 1:03d}") for x in range(signs)])
    return spark.range(n).select(F.col("id").alias("k"), length.alias("size_")).select(
        F.format_string("SYN-%05d", "k").alias("id"), F.transform(numbers, lambda x: F.get(names, x)).alias("signs"),
        of(SITES, u("site")).alias("site"), F.get(F.array(*map(F.lit, TYPES)), chosen([0.55, 0.75, 0.9, 0.96, 1.0], u("type"))).alias("object_type"),
        F.lit("unknown").alias("motif"), (u("damaged") < 0.08).alias("damaged"), F.when(u("lines") < 0.9, 1).otherwise(2).alias("line_count"),
    )
