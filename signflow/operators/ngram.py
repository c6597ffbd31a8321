"""Smoothed n-gram models under cross-validation, all folds in one job.

Counts are made once by (fold, context, sign). What a fold trains on is the total without its own rows, so
nothing is counted once for each fold, and perplexities sum over distinct n-grams, not tokens.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signflow.functions.portable import folds, global_rank
from signflow.operators.tokens import contexts
from signflow.session import discard, materialize


def _context(order: int) -> list[str]:
    return [f"c{j}" for j in range(1, order)]


def _grams(folded: DataFrame, order: int, *keys: str) -> DataFrame:
    """keys, fold, c.., w, n"""
    return contexts(folded, order, *keys, "fold").groupBy(*keys, "fold", *_context(order), "w").agg(F.count("*").alias("n"))


def _held(grams: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """For each held-out fold: its n-grams with the training count ``c`` of the n-gram, ``t`` of the context and ``d``, the context's distinct signs."""
    ctx = _context(order)
    g = grams.groupBy("fold", *ctx, "w").agg(F.sum("n").alias("n"))
    total = g.groupBy(*ctx, "w").agg(F.sum("n").alias("all_n"))
    by_ctx = total.groupBy(*ctx).agg(F.sum("all_n").alias("all_t"), F.count("*").alias("all_d"))
    own = g.where("fold >= 0").join(total, [*ctx, "w"])
    own_ctx = own.groupBy("fold", *ctx).agg(F.sum("n").alias("own_t"), F.count_if(F.col("n") == F.col("all_n")).alias("gone"))
    seen = own_ctx.join(by_ctx, ctx) if ctx else own_ctx.join(F.broadcast(by_ctx))
    seen = seen.select("fold", *ctx, (F.col("all_t") - F.col("own_t")).alias("t"), (F.col("all_d") - F.col("gone")).alias("d"))
    return own.select("fold", *ctx, "w", "n", (F.col("all_n") - F.col("n")).alias("c")), seen


def add_alpha(folded: DataFrame, orders: tuple[int, ...] = (1, 2, 3), alpha: float = 0.5) -> DataFrame:
    """order, fold, perplexity with add-alpha smoothing; the vocabulary is all signs and one more."""
    grams, _ = materialize(_grams(folded, max(orders)), "grams")
    v = grams.select("w").distinct().count() + 1
    out = []
    for order in orders:
        own, seen = _held(grams, order)
        p = (F.col("c") + alpha) / (F.col("t") + alpha * v)
        scored = own.join(seen, ["fold", *_context(order)])
        out.append(scored.groupBy("fold").agg(F.pow(F.lit(2.0), -F.sum(F.col("n") * F.log2(p)) / F.sum("n")).alias("perplexity")).select(F.lit(order).alias("order"), "fold", "perplexity"))
    df = out[0]
    for x in out[1:]:
        df = df.unionByName(x)
    return df


def kneser_ney(folded: DataFrame, orders: int = 3, discounts: tuple[float, ...] = (0.75,), *keys: str) -> DataFrame:
    """keys, order, discount, fold, perplexity of interpolated Kneser-Ney models up to ``orders``, one for each key's rows.

    Order 0 is the share of distinct predecessors (the start among them). An n-gram is one row whatever the folds, with
    its count in each of them, so what a fold trains on is a difference of two columns; lower orders are summed from
    the highest. Totals and distinct signs of a context are window sums over its rows, and each order joins the
    probabilities of the order below once. Perplexities of an order are sums over that order's own n-grams.
    """
    top = max(orders, 2)
    grams, path = materialize(_grams(folded, top, *keys), "grams")
    paths, most = [path], grams.agg(F.max("fold")).first()[0]
    held = range(0 if most is None else most + 1)
    table = {top: grams.groupBy(*keys, *_context(top), "w").agg(F.sum("n").alias("all"), *[F.sum(F.when(F.col("fold") == j, F.col("n")).otherwise(0)).alias(f"n{j}") for j in held])}
    for o in range(top, 1, -1):
        table[o], path = materialize(table[o], "counts")
        paths.append(path)
        table[o - 1] = table[o].groupBy(*keys, *_context(o - 1), "w").agg(F.sum("all").alias("all"), *[F.sum(f"n{j}").alias(f"n{j}") for j in held])
    stays = lambda j: F.col("all") > F.col(f"n{j}")  # noqa: E731  whether the n-gram is in the training rows
    kinds = table[2].groupBy(*keys, "w").agg(*[F.count_if(stays(j)).alias(f"k{j}") for j in held])
    of_kinds = kinds.groupBy(*keys).agg(F.count("*").alias("signs_"), *[F.sum(f"k{j}").alias(f"kinds{j}") for j in held])  # a row for each key
    of_signs = table[1].groupBy(*keys).agg(*[F.sum(F.col("all") - F.col(f"n{j}")).alias(f"t{j}") for j in held], *[F.count_if(stays(j)).alias(f"d{j}") for j in held])
    x = table[1].join(kinds, [*keys, "w"]).withColumn("discount", F.explode(F.array(*map(F.lit, discounts))))
    for whole in (of_kinds, of_signs):
        x = x.join(F.broadcast(whole), list(keys)) if keys else x.join(F.broadcast(whole))
    x = x.withColumns({f"p{j}": F.when(F.col(f"kinds{j}") > 0, F.try_divide(f"k{j}", f"kinds{j}")).otherwise(1.0 / F.col("signs_")) for j in held})
    each = []
    for o in range(1, orders + 1):
        if o > 1:
            own = Window.partitionBy(*keys, *_context(o))
            seen = table[o].withColumns({f"t{j}": F.sum(F.col("all") - F.col(f"n{j}")).over(own) for j in held} | {f"d{j}": F.count_if(stays(j)).over(own) for j in held})
            x = seen.join(x.select(*keys, "discount", *_context(o - 1), "w", *[f"p{j}" for j in held]), [*keys, *_context(o - 1), "w"])

        def at(j: int) -> Column:
            left, t = F.greatest(F.col("all") - F.col(f"n{j}") - F.col("discount"), F.lit(0.0)), F.col(f"t{j}")
            return F.when(t > 0, F.try_divide(left, t) + F.try_divide(F.col("discount") * F.col(f"d{j}"), t) * F.col(f"p{j}")).otherwise(F.col(f"p{j}"))

        x = x.select(*keys, "discount", *_context(o), "w", *[f"n{j}" for j in held], *[at(j).alias(f"p{j}") for j in held])
        if o < orders:
            x, path = materialize(x, "probabilities")
            paths.append(path)
        bits = x.groupBy(*keys, "discount").agg(*[F.sum(F.col(f"n{j}") * F.log2(F.greatest(F.col(f"p{j}"), F.lit(1e-12)))).alias(f"s{j}") for j in held], *[F.sum(f"n{j}").alias(f"m{j}") for j in held])
        told = [F.struct(F.lit(j).alias("fold"), F.pow(F.lit(2.0), -F.try_divide(f"s{j}", f"m{j}")).alias("perplexity")) for j in held]
        by_fold = F.explode(F.array(*told) if told else F.array().cast("array<struct<fold:int,perplexity:double>>"))
        each.append(bits.select(*keys, F.lit(o).alias("order"), "discount", by_fold.alias("x")).select(*keys, "order", "discount", "x.fold", "x.perplexity").where("perplexity is not null"))
    out, _ = materialize(reduce(DataFrame.unionByName, each), "perplexities")
    discard(folded.sparkSession, *paths)
    return out


def gains(perplexities: DataFrame, *keys: str) -> DataFrame:
    """keys, discount, order, perplexity (mean over folds) and gain = log2 of the order before minus log2 of this one."""
    mean = perplexities.groupBy(*keys, "discount", "order").agg(F.avg("perplexity").alias("perplexity"))
    before = mean.select(*keys, "discount", (F.col("order") + 1).alias("order"), F.col("perplexity").alias("before"))
    return mean.join(before, [*keys, "discount", "order"], "left").select(*keys, "discount", "order", "perplexity", (F.log2("before") - F.log2("perplexity")).alias("gain"))


def restoration(corpus: DataFrame, trials: DataFrame, alpha: float = 0.5, share: float = 0.9) -> DataFrame:
    """For each trial (id, pos; rows of at least two signs): the sign predicted from the one before it, trained on all other rows, and the size of the smallest set with ``share`` of the mass.

    Counts without a row are the totals less its own, so no model is trained again. Only signs that do follow in the
    other rows are scored: all others have the same mass and come after them in the order of signs, so how many of them
    are in the set, and whether the true one is, follows from their number and its place among all signs.
    """
    x = contexts(corpus, 2)
    totals = x.groupBy("c1", "w").agg(F.count("*").alias("n"))
    places = global_rank(totals.select("w").distinct(), "w").select(F.col("w").alias("truth"), F.col("rank").alias("place"))
    v, least = places.count(), places.agg(F.min("truth").alias("least"))
    asked = x.join(trials.select("id", "pos"), ["id", "pos"]).select("id", "pos", "c1", F.col("w").alias("truth"))
    own = x.join(trials.select("id").distinct(), "id", "left_semi").groupBy("id", "c1", "w").agg(F.count("*").alias("own"))
    follows = asked.join(totals, "c1").join(own, ["id", "c1", "w"], "left").withColumn("c", F.col("n") - F.coalesce("own", F.lit(0))).where("c > 0")
    one = Window.partitionBy("id", "pos")
    mass = F.col("c") + alpha
    before = F.coalesce(F.sum(mass).over(one.orderBy(F.desc("c"), "w").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    scored = follows.withColumn("kept", before / (F.sum("c").over(one) + alpha * v) < share)
    true = F.col("w") == F.col("truth")
    told = scored.groupBy("id", "pos").agg(
        F.sum("c").alias("t"), F.count("*").alias("m"), F.min(F.struct((-F.col("c")).alias("minus"), "w"))["w"].alias("top"), F.count_if("kept").alias("kept"),
        F.bool_or(true).alias("follows"), F.bool_or(true & F.col("kept")).alias("true_kept"), F.count_if(F.col("w") < F.col("truth")).alias("below"),
    )
    res = asked.join(told, ["id", "pos"], "left").join(places, "truth").join(F.broadcast(least)).fillna(0, ["t", "m", "kept", "below"])
    rest = F.greatest(F.lit(0), F.least(F.ceil((share * (F.col("t") + alpha * v) - F.col("t") - alpha * F.col("m")) / alpha), v - F.col("m")))  # of the others, those in the set
    in_set = F.when(F.coalesce("follows", F.lit(False)), F.col("true_kept")).otherwise(F.col("place") - F.col("below") < rest)
    return res.select("id", "pos", "truth", F.coalesce("top", "least").alias("predicted"), (F.col("kept") + rest).cast("bigint").alias("set_size"), in_set.alias("in_set"))


def restored(trials: DataFrame) -> DataFrame:
    """Of a table of restorations: trials, the share restored, the share whose truth is in the set, and the set's mean size. One row."""
    hit = F.avg((F.col("predicted") == F.col("truth")).cast("double"))
    return trials.agg(F.count("*").alias("n"), hit.alias("accuracy"), F.avg(F.col("in_set").cast("double")).alias("set_accuracy"), F.avg("set_size").alias("mean_set_size"))


def perplexity_ratio(corpus: DataFrame, key: str, k: int = 3, alpha: float = 0.5, seed: int = 0) -> DataFrame:
    """key, ratio: mean perplexity of order 2 over that of order 1, each part of the corpus under its own ``k`` folds (in hashed order; the remainder always trains)."""
    folded = folds(corpus.select(key, "id", "signs"), k, seed, key)
    grams, _ = materialize(contexts(folded, 2, key, "fold").groupBy(key, "fold", "c1", "w").agg(F.count("*").alias("n")), "grams")
    return perplexity_ratio_of(grams, key, alpha)


def perplexity_ratio_of(grams: DataFrame, key: str, alpha: float = 0.5) -> DataFrame:
    """``perplexity_ratio`` from the counts ``n`` of key, fold, c1, w."""
    kinds = grams.groupBy(key).agg((F.count_distinct("w") + 1).alias("v"))

    def perplexity(order: int) -> DataFrame:
        ctx = [key, *(["c1"] if order == 2 else [])]
        g = grams.groupBy(*ctx, "fold", "w").agg(F.sum("n").alias("n"))
        total = g.groupBy(*ctx, "w").agg(F.sum("n").alias("all_n"))
        by_ctx = total.groupBy(*ctx).agg(F.sum("all_n").alias("all_t"))
        own = g.where("fold >= 0")
        own_t = own.groupBy(*ctx, "fold").agg(F.sum("n").alias("own_t"))
        x = own.join(total, [*ctx, "w"]).join(own_t, [*ctx, "fold"]).join(by_ctx, ctx).join(F.broadcast(kinds), key)
        p = (F.col("all_n") - F.col("n") + alpha) / (F.col("all_t") - F.col("own_t") + alpha * F.col("v"))
        each = x.groupBy(key, "fold").agg(F.pow(F.lit(2.0), -F.sum(F.col("n") * F.log2(p)) / F.sum("n")).alias("p"))
        return each.groupBy(key).agg(F.avg("p").alias(f"p{order}"))

    return perplexity(1).join(perplexity(2), key).select(key, (F.col("p2") / F.col("p1")).alias("ratio"))
