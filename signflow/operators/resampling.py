"""Statistics over trials, and classification of corpora by their features. Trials are a column or a bitmap, not a loop; the few synthetic reference corpora are one plan each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signflow.functions.portable import folds, hashed, wilson
from signflow.operators import ngram, nulls, stats, vectors
from signflow.operators.tokens import contexts
from signflow.session import discard, materialize

FEATURES = ("zipf_gamma", "zipf_r2", "entropy", "perplexity_ratio", "top_final_share", "mean_len")


def over_trials(trials: DataFrame, value: str, real: float | Column, *keys: str) -> DataFrame:
    """keys, n, mean, low, high, sd (of the population) of ``value`` over the trials, the real value, and the share of trials that reach it (an empirical p-value)."""
    real = real if isinstance(real, Column) else F.lit(real)
    x = F.col(value)
    return trials.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high"), F.stddev_pop(x).alias("sd"), F.first(real).alias("real"), F.avg((x >= real).cast("double")).alias("p_value"))


def differences(features: DataFrame, label: str, real: str, names: list[str]) -> DataFrame:
    """label, feature, mean, real_mean, pct_diff of each feature's mean over the instances of a label against those of the label ``real``."""
    long = features.select(label, F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x")) for n in names])).alias("f")).select(label, "f.*")
    means = long.groupBy(label, "feature").agg(F.avg("x").alias("mean"))
    base = means.where(F.col(label) == real).select("feature", F.col("mean").alias("real_mean"))
    return means.where(F.col(label) != real).join(F.broadcast(base), "feature").withColumn("pct_diff", F.abs(F.col("real_mean") - F.col("mean")) / (F.abs("real_mean") + 1e-9) * 100)


def verdict(share: Column, high: float, low: float, names: tuple[str, str, str]) -> Column:
    """The first name from ``high`` on, the last up to ``low``, the middle one between; null for a null share."""
    return F.when(share.isNull(), None).when(share >= high, names[0]).when(share <= low, names[2]).otherwise(names[1])


def label_shares(predicted: DataFrame, *keys: str) -> DataFrame:
    """keys, predicted, n, share of the key's trials, its binomial error, and Wilson's interval."""
    counts = predicted.groupBy(*keys, "predicted").agg(F.count("*").alias("n"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("trials"))
    x = counts.join(total, list(keys)) if keys else counts.join(F.broadcast(total))
    p = F.col("n") / F.col("trials")
    low, high = wilson(F.col("n"), F.col("trials"))
    return x.select(*keys, "predicted", "n", "trials", p.alias("share"), F.sqrt(p * (1 - p) / F.col("trials")).alias("error"), low.alias("low"), high.alias("high"))


def features(corpus: DataFrame, key: str) -> DataFrame:
    """key and the six FEATURES of each part of the corpus that the column ``key`` names."""
    corpus, path = materialize(corpus.select(key, "id", "signs"), "corpora")
    folded = folds(corpus, 3, 0, key, written=True).withColumn("size_", F.size("signs"))
    place = [(F.col("pos") == 0).alias("first_"), (F.col("pos") == F.col("size_") - 1).alias("last_")]
    grams, grams_path = materialize(contexts(folded, 2, key, "fold", "size_").groupBy(key, "fold", *place, "c1", "w").agg(F.count("*").alias("n")), "grams")  # tokens are counted once, for every feature
    of = lambda rows, *by: rows.groupBy(key, *by).agg(F.sum("n").alias("n"))
    zipf = vectors.zipf(of(grams, F.col("w").alias("sign")), key, counted=True).select(key, F.col("gamma").alias("zipf_gamma"), F.col("r2").alias("zipf_r2"))
    ends = of(grams.where("last_"), "w").groupBy(key).agg((F.max("n") / F.sum("n")).alias("top_final_share"))
    entropy = stats.conditional_entropy_of(of(grams.where("not first_"), F.col("c1").alias("a"), F.col("w").alias("b")), key).select(key, "entropy")
    ratio = ngram.perplexity_ratio_of(of(grams, "fold", "c1", "w"), key).withColumnRenamed("ratio", "perplexity_ratio")
    parts = [entropy, ratio, ends, corpus.groupBy(key).agg(F.coalesce(F.avg(F.size("signs")), F.lit(0.0)).alias("mean_len"))]
    for x in parts:
        zipf = zipf.join(x, key)
    out, _ = materialize(zipf.select(key, *FEATURES), "features")
    discard(corpus.sparkSession, path, grams_path)
    return out


def references(spark: SparkSession, kinds: str = "abc", seeds: int = 4, n: int = 500) -> DataFrame:
    """key (label/seed), id, signs: instances of the labelled synthetic corpora."""
    out = None
    for kind in kinds:
        for seed in range(seeds):
            one = nulls.civilization(spark, kind, n, seed).select(F.lit(f"{kind}/{seed}").alias("key"), "id", "signs")
            out = one if out is None else out.unionByName(one)
    return out


def with_trials(corpus: DataFrame, n: int, trials: int, seed: int = 0) -> DataFrame:
    """The rows of ``corpus`` that are in any trial's sample of ``n`` rows, each with ``trials``, a bitmap (longs) of the trials it is in; the same samples as ``nulls.subsample``. Written once."""
    known = {r["trial"]: r["cut"] for r in nulls.cuts(corpus, trials, seed, n).collect()}  # one for each trial
    cuts = F.array(*[F.lit(known.get(t, "")) for t in range(trials)])
    fanned = corpus.select("id", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    taken = fanned.where(hashed(F.col("trial"), seed, F.col("id")) <= F.get(cuts, F.col("trial")))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("trial") % 64)
    words = [F.bit_or(F.when(F.floor(F.col("trial") / 64) == i, bit).otherwise(F.lit(0).cast("bigint"))) for i in range(-(-trials // 64))]
    members = taken.groupBy("id").agg(F.array(*words).alias("trials"))
    return materialize(corpus.join(members, "id"), "sampled")[0].select(*corpus.columns, "trials")


def classify(queries: DataFrame, labelled: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """query, predicted, distance: each query's nearest centroid, after z-scores over its own features and all labelled ones.

    ``queries``: query and features. ``labelled``: label and features, one row for each instance; both are small tables
    of features, one row for each corpus.
    """
    z = lambda n: (F.col(n) - F.col(f"{n}_m")) / F.col(f"{n}_s")
    m = labelled.agg(F.count("*").alias("k"), *[f(F.col(n)).alias(f"{n}_{t}") for n in names for t, f in (("t", F.sum), ("q", lambda c: F.sum(c * c)))])
    with_query = queries.join(F.broadcast(m))
    k = F.col("k") + 1
    for n in names:  # mean and deviation with the query among the rows
        mean = (F.col(f"{n}_t") + F.col(n)) / k
        sd = F.sqrt(F.greatest((F.col(f"{n}_q") + F.col(n) * F.col(n)) / k - mean * mean, F.lit(0.0)))
        with_query = with_query.withColumn(f"{n}_m", mean).withColumn(f"{n}_s", F.when(sd > 1e-12, sd).otherwise(1.0))
    centroids = labelled.groupBy("label").agg(*[F.avg(n).alias(f"{n}_c") for n in names])
    grid = with_query.join(F.broadcast(centroids))
    d = F.sqrt(sum((F.pow(z(n) - (F.col(f"{n}_c") - F.col(f"{n}_m")) / F.col(f"{n}_s"), F.lit(2.0)) for n in names), F.lit(0.0)))
    ranked = grid.withColumn("distance", d).withColumn("rank_", F.row_number().over(Window.partitionBy("query").orderBy("distance", "label")))
    return ranked.where("rank_ = 1").select("query", F.col("label").alias("predicted"), "distance")


def ledger(spark: SparkSession, checks: list[tuple[str, Column | None, str]], table: DataFrame) -> DataFrame:
    """name, status, detail of each check over a one-row ``table``: PASS, FAIL, or SKIPPED where the condition is None or null."""
    said = lambda c: F.lit("SKIPPED") if c is None else F.when(c, "PASS").when(~c, "FAIL").otherwise("SKIPPED")
    rows = [F.struct(F.lit(n).alias("name"), said(c).alias("status"), F.lit(d).alias("detail")) for n, c, d in checks]
    return table.select(F.inline(F.array(*rows)))


def within(value: Column, expected: float, tolerance: float) -> Column:
    return F.abs(value - expected) <= tolerance
