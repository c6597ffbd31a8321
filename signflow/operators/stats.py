"""Frequencies, positions, entropies and association of signs. ``keys`` are columns to keep apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signflow.operators.tokens import counted, pairs, tokens
from signflow.session import discard, materialize


def summary(corpus: DataFrame, *keys: str) -> DataFrame:
    """n, n_signs, n_tokens, mean_len, min_len, max_len; 0 for an empty corpus. Lengths come from array sizes, only the vocabulary explodes."""
    size = F.size("signs")
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind)
    lengths = corpus.groupBy(*keys).agg(F.count("*").alias("n"), zero(F.sum(size), "bigint").alias("n_tokens"), zero(F.avg(size), "double").alias("mean_len"), zero(F.min(size), "int").alias("min_len"), zero(F.max(size), "int").alias("max_len"))
    kinds = counted(tokens(corpus, *keys), *keys, "sign").groupBy(*keys).agg(F.count("*").alias("n_signs"))
    return lengths.join(kinds, list(keys), "left").fillna(0, ["n_signs"]) if keys else lengths.join(F.broadcast(kinds))


def unigrams(corpus: DataFrame, *keys: str) -> DataFrame:
    return counted(tokens(corpus, *keys), *keys, "sign")


def edge_counts(corpus: DataFrame, last: bool, *keys: str) -> DataFrame:
    """How often each sign begins (or ends) a row."""
    return counted(corpus.where(F.size("signs") > 0).select(*keys, F.element_at("signs", -1 if last else 1).alias("sign")), *keys, "sign")


def bigrams(corpus: DataFrame, *keys: str) -> DataFrame:
    return counted(pairs(corpus, *keys), *keys, "a", "b")


def slot_counts(corpus: DataFrame) -> DataFrame:
    """sign, n, n_initial, n_final in one pass over the tokens."""
    t = tokens(corpus)
    return t.groupBy("sign").agg(F.count("*").alias("n"), F.count_if(F.col("pos") == 0).alias("n_initial"), F.count_if(F.col("pos") == F.col("len") - 1).alias("n_final"))


def asymmetry(corpus: DataFrame, top: int = 10) -> DataFrame:
    """The commonest signs with their share of all tokens, of first places and of last places."""
    c = slot_counts(corpus)
    total = c.agg(F.sum("n").alias("t"), F.sum("n_initial").alias("ti"), F.sum("n_final").alias("tf"))
    shares = [(F.col(x) / F.col(t)).alias(s) for x, t, s in (("n", "t", "share"), ("n_initial", "ti", "initial_share"), ("n_final", "tf", "final_share"))]
    return c.join(F.broadcast(total)).select("sign", "n", "n_initial", "n_final", *shares).orderBy(F.desc("n"), "sign").limit(top)


def doubling(corpus: DataFrame) -> DataFrame:
    """sign, n, n_doubled, rate: occurrences with an equal neighbour on either side."""
    s = F.col("signs")
    near = F.transform(s, lambda x, i: F.struct(x.alias("sign"), (F.coalesce(F.get(s, i - 1) == x, F.lit(False)) | F.coalesce(F.get(s, i + 1) == x, F.lit(False))).alias("twin")))
    return corpus.select(F.inline(near)).groupBy("sign").agg(F.count("*").alias("n"), F.count_if("twin").alias("n_doubled")).withColumn("rate", F.col("n_doubled") / F.col("n"))


def uniqueness(corpus: DataFrame, *keys: str) -> DataFrame:
    """distinct sequences, rows, and their ratio. Counted in two steps, so a common sequence is no hot key."""
    each = counted(corpus.select(*keys, "signs"), *keys, "signs")
    return each.groupBy(*keys).agg(F.count("*").alias("n_distinct"), F.sum("n").alias("n")).withColumn("uniqueness", F.col("n_distinct") / F.col("n"))


def entropy_of(counts: DataFrame, *keys: str) -> DataFrame:
    """Shannon entropy of the counts ``n``, in bits: log2(t) - sum(n log2 n) / t."""
    return counts.groupBy(*keys).agg(F.sum("n").alias("t"), F.count("*").alias("n_distinct"), F.sum(F.col("n") * F.log2("n")).alias("s")).select(*keys, "n_distinct", (F.log2("t") - F.col("s") / F.col("t")).alias("entropy"))


def conditional_entropy_of(bigram_counts: DataFrame, *keys: str) -> DataFrame:
    """H(next | sign) from bigram counts: two aggregations, no window over the whole table."""
    rows = bigram_counts.groupBy(*keys, "a").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return rows.groupBy(*keys).agg(((F.sum(F.col("m") * F.log2("m")) - F.sum("s")) / F.sum("m")).alias("entropy"), F.sum("m").alias("n_bigrams"))


def conditional_entropy(corpus: DataFrame, *keys: str) -> DataFrame:
    return conditional_entropy_of(bigrams(corpus, *keys), *keys)


def entropy_by_length(corpus: DataFrame, longest: int = 6) -> DataFrame:
    """Conditional entropy of the first k signs, k from 2 to ``longest`` (one sign has no pair)."""
    c = counted(pairs(corpus).where(F.col("pos") <= longest - 2), F.col("pos"), "a", "b")
    grown = c.select(F.explode(F.sequence(F.col("pos") + 2, F.lit(longest))).alias("k"), "a", "b", "n").groupBy("k", "a", "b").agg(F.sum("n").alias("n"))
    return conditional_entropy_of(grown, "k")


def direction(corpus: DataFrame) -> DataFrame:
    """Entropies of both ends and of transitions, as stored and reversed, and which way reads better. One row."""
    (c, one_path), (b, two_path) = materialize(slot_counts(corpus), "slots"), materialize(bigrams(corpus), "bigrams")
    end = lambda n: entropy_of(c.where(F.col(n) > 0).select(F.col(n).alias("n")))
    ahead, back = conditional_entropy_of(b), conditional_entropy_of(b.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    one = end("n_initial").select(F.col("entropy").alias("h_initial"), F.col("n_distinct").alias("n_initial"))
    for df, h, n in ((end("n_final"), "h_final", "n_final"), (ahead, "h_stored", None), (back, "h_reversed", None)):
        one = one.join(F.broadcast(df.select(F.col("entropy").alias(h), *([F.col("n_distinct").alias(n)] if n else []))))
    gap = F.col("h_initial") - F.col("h_final")
    out, _ = materialize(one.withColumn("gap", gap).withColumn("likely", F.when(gap > 0, "as-stored").when(gap < 0, "reversed").otherwise("inconclusive")), "direction")
    discard(corpus.sparkSession, one_path, two_path)
    return out


def transitions(corpus: DataFrame, *keys: str) -> DataFrame:
    """a, b, n, p = n over all of a's transitions."""
    b = bigrams(corpus, *keys)
    return b.join(b.groupBy(*keys, "a").agg(F.sum("n").alias("m")), [*keys, "a"]).select(*keys, "a", "b", "n", (F.col("n") / F.col("m")).alias("p"))


def g2(corpus: DataFrame, min_count: int = 3) -> DataFrame:
    """a, b, n, p_b_given_a (over a's unigram count) and the log-likelihood ratio of frequent bigrams."""
    b = bigrams(corpus).where(F.col("n") >= min_count)
    u = unigrams(corpus)
    total = u.agg(F.sum("n").alias("t"))
    x = b.join(u.select(F.col("sign").alias("a"), F.col("n").alias("na")), "a").join(u.select(F.col("sign").alias("b"), F.col("n").alias("nb")), "b").join(F.broadcast(total))
    o11, na, nb, t = F.col("n"), F.col("na"), F.col("nb"), F.col("t")

    def term(o: Column, r: Column, c: Column) -> Column:
        e = r * c / t
        return F.when((o > 0) & (e > 0), o * F.ln(o / e)).otherwise(0.0)

    ratio = 2 * (term(o11, na, nb) + term(na - o11, na, t - nb) + term(nb - o11, t - na, nb) + term(t - na - nb + o11, t - na, t - nb))
    return x.select("a", "b", "n", (o11 / na).alias("p_b_given_a"), ratio.alias("g2"))


def network(corpus: DataFrame) -> DataFrame:
    """Of the directed graph of adjacent signs: signs, edges, connectivity (edges over signs squared), mutual edges, beginners, enders and signs seen only alone. One row."""
    c = tokens(corpus).groupBy("sign").agg(F.bool_and(F.col("pos") == 0).alias("first"), F.bool_and(F.col("pos") == F.col("len") - 1).alias("last"), F.bool_and(F.col("len") == 1).alias("solo"))
    nodes = c.agg(F.count("*").alias("n_signs"), F.count_if("first").alias("n_beginners"), F.count_if("last").alias("n_enders"), F.count_if("solo").alias("n_solo"))
    e = pairs(corpus).select("a", "b").distinct()
    mutual = e.join(e.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi").agg(F.count("*").alias("n_mutual"))
    edges = e.agg(F.count("*").alias("n_edges"))
    return nodes.join(F.broadcast(edges)).join(F.broadcast(mutual)).withColumn("connectivity", F.col("n_edges") / (F.col("n_signs") * F.col("n_signs")))
