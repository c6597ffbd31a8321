"""The registered queries over the driver's tables, and the SQL they are held against."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signflow.functions.portable import folds, uniform, wilson
from signflow.operators import ngram, nulls, resampling, stats, substitution, vectors
from signflow.operators.tokens import counted, tokens
from signflow.session import discard, materialize
from signflow.sources import corpus as source


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders corpus in reading order, without damaged rows."""
    return source.keep(source.normalized(source.orders_corpus(spark, sf_dir)))


def over_corpus(f: Callable) -> Callable:
    """A query over the corpus that reads it more than once: written once before, deleted when the result is written."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c, path = materialize(_orders(spark, sf_dir).select("id", "signs", "site", "object_type", "motif"), "corpus")
        out, _ = materialize(f(c), f.__name__.replace("_", "-"))
        discard(spark, path)
        return out

    return run


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


#: The same corpus in SQL.
ORDERS = """raw AS (
  SELECT l_orderkey, list(p_brand ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, p_brand) AS s
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
full_corpus AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 1 THEN list_reverse(s) ELSE s END AS signs, n_name AS site,
    o_orderpriority AS object_type, c_mktsegment AS motif, o_orderstatus = 'P' AS damaged
  FROM raw JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
corpus AS (SELECT * FROM full_corpus WHERE NOT damaged),
tok AS (SELECT id, site, unnest(signs) AS sign, unnest(range(len(signs))) AS pos, len(signs) AS len FROM corpus),
pairs AS (SELECT id, site, pos, sign AS a, lead(sign) OVER (PARTITION BY id ORDER BY pos) AS b FROM tok QUALIFY b IS NOT NULL),
big AS (SELECT a, b, count(*) AS n FROM pairs GROUP BY 1, 2),
uni AS (SELECT sign, count(*) AS n FROM tok GROUP BY 1)"""
WITH = f"WITH {ORDERS}"

_registry: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        _registry[f.__name__] = (f, sql)
        return f

    return keep


@query(f"""{WITH} SELECT site, round(-sum(n / t::DOUBLE * log2(n / m::DOUBLE)), 6) AS entropy, sum(n)::BIGINT AS n_bigrams FROM (
  SELECT site, a, b, n, sum(n) OVER (PARTITION BY site, a) AS m, sum(n) OVER (PARTITION BY site) AS t FROM (SELECT site, a, b, count(*) AS n FROM pairs GROUP BY ALL)) GROUP BY site""")
def conditional_entropy_by_site(spark, sf_dir):
    return _rounded(stats.conditional_entropy(_orders(spark, sf_dir), "site"), "entropy")


@query(f"""{WITH} SELECT count(*)::BIGINT AS n, (SELECT count(*) FROM uni)::BIGINT AS n_signs, sum(len(signs))::BIGINT AS n_tokens, round(avg(len(signs)), 6) AS mean_len, min(len(signs))::INT AS min_len, max(len(signs))::INT AS max_len FROM corpus""")
def corpus_summary(spark, sf_dir):
    return _rounded(stats.summary(_orders(spark, sf_dir)).select("n", "n_signs", "n_tokens", "mean_len", "min_len", "max_len"), "mean_len")


@query(f"{WITH} SELECT DISTINCT sign FROM tok")
def vocab(spark, sf_dir):
    return tokens(_orders(spark, sf_dir)).select("sign").distinct()


@query(f"{WITH} SELECT sign, n::BIGINT AS n FROM uni")
def unigram_counts(spark, sf_dir):
    return stats.unigrams(_orders(spark, sf_dir))


@query(f"{WITH} SELECT a, b, n::BIGINT AS n FROM big")
def bigram_counts(spark, sf_dir):
    return stats.bigrams(_orders(spark, sf_dir))


@query(f"{WITH} SELECT signs[1] AS sign, count(*)::BIGINT AS n FROM corpus GROUP BY 1")
def initial_counts(spark, sf_dir):
    return stats.edge_counts(_orders(spark, sf_dir), False)


@query(f"{WITH} SELECT signs[-1] AS sign, count(*)::BIGINT AS n FROM corpus GROUP BY 1")
def final_counts(spark, sf_dir):
    return stats.edge_counts(_orders(spark, sf_dir), True)


@query(f"""{WITH}, s AS (SELECT sign, count(*)::BIGINT AS n, count(*) FILTER (pos = 0)::BIGINT AS n_initial, count(*) FILTER (pos = len - 1)::BIGINT AS n_final FROM tok GROUP BY 1)
SELECT sign, n, n_initial, n_final, round(n / (SELECT sum(n) FROM s)::DOUBLE, 6) AS share, round(n_initial / (SELECT sum(n_initial) FROM s)::DOUBLE, 6) AS initial_share,
  round(n_final / (SELECT sum(n_final) FROM s)::DOUBLE, 6) AS final_share FROM s ORDER BY n DESC, sign LIMIT 10""")
def positional_asymmetry(spark, sf_dir):
    """A top-10 report."""
    return _rounded(stats.asymmetry(_orders(spark, sf_dir)), "share", "initial_share", "final_share")


@query(f"""{WITH}, x AS (SELECT sign, coalesce(lag(sign) OVER w = sign, false) OR coalesce(lead(sign) OVER w = sign, false) AS twin FROM tok WINDOW w AS (PARTITION BY id ORDER BY pos))
SELECT sign, count(*)::BIGINT AS n, count(*) FILTER (twin)::BIGINT AS n_doubled, round(count(*) FILTER (twin) / count(*)::DOUBLE, 6) AS rate FROM x GROUP BY 1""")
def doubling_rate(spark, sf_dir):
    return _rounded(stats.doubling(_orders(spark, sf_dir)), "rate")


@query(f"{WITH} SELECT a, b, n::BIGINT AS n, round(n / sum(n) OVER (PARTITION BY a)::DOUBLE, 6) AS p FROM big")
def transition_matrix(spark, sf_dir):
    return _rounded(stats.transitions(_orders(spark, sf_dir)), "p")


@query(f"""{WITH}, x AS (SELECT a, b, big.n::DOUBLE AS o11, ua.n::DOUBLE AS na, ub.n::DOUBLE AS nb, (SELECT sum(n) FROM uni)::DOUBLE AS t FROM big JOIN uni ua ON ua.sign = a JOIN uni ub ON ub.sign = b WHERE big.n >= 3),
y AS (SELECT *, na - o11 AS o12, nb - o11 AS o21, t - na - nb + o11 AS o22 FROM x)
SELECT a, b, o11::BIGINT AS n, round(o11 / na, 6) AS p_b_given_a, round(2 * (CASE WHEN o11 > 0 THEN o11 * ln(o11 * t / (na * nb)) ELSE 0 END + CASE WHEN o12 > 0 AND t > nb THEN o12 * ln(o12 * t / (na * (t - nb))) ELSE 0 END
  + CASE WHEN o21 > 0 AND t > na THEN o21 * ln(o21 * t / ((t - na) * nb)) ELSE 0 END + CASE WHEN o22 > 0 THEN o22 * ln(o22 * t / ((t - na) * (t - nb))) ELSE 0 END), 4) AS g2 FROM y""")
def llr_bigrams(spark, sf_dir):
    return stats.g2(_orders(spark, sf_dir)).withColumns({"p_b_given_a": F.round("p_b_given_a", 6), "g2": F.round("g2", 4)})


@query(f"""{WITH} SELECT round(-sum(n / t::DOUBLE * log2(n / m::DOUBLE)), 6) AS entropy, sum(n)::BIGINT AS n_bigrams FROM (SELECT n, sum(n) OVER (PARTITION BY a) AS m, sum(n) OVER () AS t FROM big)""")
def conditional_entropy(spark, sf_dir):
    return _rounded(stats.conditional_entropy(_orders(spark, sf_dir)), "entropy")


@query(f"""{WITH}, g AS (SELECT k, a, b, count(*) AS n FROM pairs JOIN (SELECT unnest(range(2, 7)) AS k) ON pos + 2 <= k GROUP BY ALL)
SELECT k::INT AS k, round(-sum(n / t::DOUBLE * log2(n / m::DOUBLE)), 6) AS entropy, sum(n)::BIGINT AS n_bigrams FROM (SELECT k, n, sum(n) OVER (PARTITION BY k, a) AS m, sum(n) OVER (PARTITION BY k) AS t FROM g) GROUP BY k""")
def entropy_by_length(spark, sf_dir):
    return _rounded(stats.entropy_by_length(_orders(spark, sf_dir)).withColumn("k", F.col("k").cast("int")), "entropy")


@query(f"""{WITH}, i AS (SELECT count(*) AS n FROM tok WHERE pos = 0 GROUP BY sign), f AS (SELECT count(*) AS n FROM tok WHERE pos = len - 1 GROUP BY sign),
h AS (SELECT (SELECT -sum(n / t * log2(n / t)) FROM (SELECT n, sum(n) OVER ()::DOUBLE AS t FROM i)) AS h_initial, (SELECT -sum(n / t * log2(n / t)) FROM (SELECT n, sum(n) OVER ()::DOUBLE AS t FROM f)) AS h_final,
  (SELECT -sum(n / t * log2(n / m)) FROM (SELECT n, sum(n) OVER (PARTITION BY a)::DOUBLE AS m, sum(n) OVER ()::DOUBLE AS t FROM big)) AS h_stored,
  (SELECT -sum(n / t * log2(n / m)) FROM (SELECT n, sum(n) OVER (PARTITION BY b)::DOUBLE AS m, sum(n) OVER ()::DOUBLE AS t FROM big)) AS h_reversed)
SELECT round(h_initial, 6) AS h_initial, (SELECT count(*) FROM i)::BIGINT AS n_initial, round(h_final, 6) AS h_final, (SELECT count(*) FROM f)::BIGINT AS n_final, round(h_stored, 6) AS h_stored, round(h_reversed, 6) AS h_reversed,
  round(h_initial - h_final, 6) AS gap, CASE WHEN h_initial > h_final THEN 'as-stored' WHEN h_initial < h_final THEN 'reversed' ELSE 'inconclusive' END AS likely FROM h""")
def reading_direction(spark, sf_dir):
    return _rounded(stats.direction(_orders(spark, sf_dir)), "h_initial", "h_final", "h_stored", "h_reversed", "gap")


@query(f"{WITH} SELECT count(DISTINCT signs)::BIGINT AS n_distinct, count(*)::BIGINT AS n, round(count(DISTINCT signs) / count(*)::DOUBLE, 6) AS uniqueness FROM corpus")
def uniqueness(spark, sf_dir):
    return _rounded(stats.uniqueness(_orders(spark, sf_dir)), "uniqueness")


@query(f"{WITH} SELECT len(signs)::INT AS len, count(DISTINCT signs)::BIGINT AS n_distinct, count(*)::BIGINT AS n, round(count(DISTINCT signs) / count(*)::DOUBLE, 6) AS uniqueness FROM corpus GROUP BY 1")
def uniqueness_by_length(spark, sf_dir):
    return _rounded(stats.uniqueness(_orders(spark, sf_dir).withColumn("len", F.size("signs")), "len"), "uniqueness")


#: Folds in SQL: five equal ones by hashed order, the remainder -1; padded contexts; counts by fold.
FOLDS = f"""{WITH}, r AS (SELECT *, row_number() OVER (ORDER BY md5('0|' || id), id) - 1 AS r, count(*) OVER () // 5 AS size FROM corpus),
fo AS (SELECT id, signs, CASE WHEN r < 5 * size THEN (r // size)::INT ELSE -1 END AS fold FROM r),
x AS (SELECT fold, sign AS w, lag(sign, 1, '<S>') OVER q AS c1, lag(sign, 2, '<S>') OVER q AS c2 FROM (SELECT id, fold, unnest(signs) AS sign, unnest(range(len(signs))) AS pos FROM fo) WINDOW q AS (PARTITION BY id ORDER BY pos)),
ks AS (SELECT unnest(range(5)) AS k), tr AS (SELECT k, w, c1, c2 FROM x JOIN ks ON fold <> k), he AS (SELECT fold AS k, w, c1, c2 FROM x WHERE fold >= 0),
g1 AS (SELECT k, w, count(*) AS n FROM tr GROUP BY ALL), g2 AS (SELECT k, c1, w, count(*) AS n FROM tr GROUP BY ALL), g3 AS (SELECT k, c1, c2, w, count(*) AS n FROM tr GROUP BY ALL),
t1 AS (SELECT k, sum(n) AS t, count(*) AS d FROM g1 GROUP BY ALL), t2 AS (SELECT k, c1, sum(n) AS t, count(*) AS d FROM g2 GROUP BY ALL), t3 AS (SELECT k, c1, c2, sum(n) AS t, count(*) AS d FROM g3 GROUP BY ALL)"""


@query(f"""{FOLDS}, v AS (SELECT count(*) + 1 AS v FROM uni), p AS (SELECT he.k,
  (coalesce(g1.n, 0) + 0.5) / (coalesce(t1.t, 0) + 0.5 * v) AS p1, (coalesce(g2.n, 0) + 0.5) / (coalesce(t2.t, 0) + 0.5 * v) AS p2, (coalesce(g3.n, 0) + 0.5) / (coalesce(t3.t, 0) + 0.5 * v) AS p3
  FROM he CROSS JOIN v LEFT JOIN g1 USING (k, w) LEFT JOIN t1 USING (k) LEFT JOIN g2 USING (k, c1, w) LEFT JOIN t2 USING (k, c1) LEFT JOIN g3 USING (k, c1, c2, w) LEFT JOIN t3 USING (k, c1, c2))
SELECT 1 AS "order", k::INT AS fold, round(pow(2, -avg(log2(p1))), 4) AS perplexity FROM p GROUP BY k UNION ALL SELECT 2, k::INT, round(pow(2, -avg(log2(p2))), 4) FROM p GROUP BY k UNION ALL SELECT 3, k::INT, round(pow(2, -avg(log2(p3))), 4) FROM p GROUP BY k""")
def addalpha_cv_ppl(spark, sf_dir):
    df = ngram.add_alpha(folds(_orders(spark, sf_dir).select("id", "signs"), 5))
    return df.withColumn("perplexity", F.round("perplexity", 4))


KN = f"""{FOLDS}, b AS (SELECT DISTINCT k, c1, w FROM tr), bw AS (SELECT k, w, count(*) AS kinds FROM b GROUP BY ALL), bk AS (SELECT k, count(*) AS kinds FROM b GROUP BY ALL), ds AS (SELECT unnest([0.5, 0.75, 0.9])::DOUBLE AS dis),
q AS (SELECT dis, he.k, coalesce(bw.kinds, 0) / bk.kinds::DOUBLE AS p0, g1.n AS n1, t1.t AS s1, t1.d AS d1, g2.n AS n2, t2.t AS s2, t2.d AS d2, g3.n AS n3, t3.t AS s3, t3.d AS d3
  FROM he CROSS JOIN ds JOIN bk USING (k) LEFT JOIN bw USING (k, w) LEFT JOIN g1 USING (k, w) LEFT JOIN t1 USING (k) LEFT JOIN g2 USING (k, c1, w) LEFT JOIN t2 USING (k, c1) LEFT JOIN g3 USING (k, c1, c2, w) LEFT JOIN t3 USING (k, c1, c2)),
q1 AS (SELECT *, CASE WHEN s1 IS NULL THEN p0 ELSE greatest(coalesce(n1, 0) - dis, 0) / s1::DOUBLE + dis * d1 / s1::DOUBLE * p0 END AS p1 FROM q),
q2 AS (SELECT *, CASE WHEN s2 IS NULL THEN p1 ELSE greatest(coalesce(n2, 0) - dis, 0) / s2::DOUBLE + dis * d2 / s2::DOUBLE * p1 END AS p2 FROM q1),
q3 AS (SELECT *, CASE WHEN s3 IS NULL THEN p2 ELSE greatest(coalesce(n3, 0) - dis, 0) / s3::DOUBLE + dis * d3 / s3::DOUBLE * p2 END AS p3 FROM q2),
ppl AS (SELECT 1 AS o, dis, k, pow(2, -avg(log2(greatest(p1, 1e-12)))) AS p FROM q3 GROUP BY ALL UNION ALL SELECT 2, dis, k, pow(2, -avg(log2(greatest(p2, 1e-12)))) FROM q3 GROUP BY ALL UNION ALL SELECT 3, dis, k, pow(2, -avg(log2(greatest(p3, 1e-12)))) FROM q3 GROUP BY ALL)"""
DISCOUNTS = (0.5, 0.75, 0.9)


@query(f'{KN} SELECT o AS "order", dis AS discount, k::INT AS fold, round(p, 4) AS perplexity FROM ppl')
def kn_cv_ppl(spark, sf_dir):
    df = ngram.kneser_ney(folds(_orders(spark, sf_dir).select("id", "signs"), 5), 3, DISCOUNTS)
    return df.withColumn("perplexity", F.round("perplexity", 4))


@query(f'{KN}, m AS (SELECT o, dis, avg(p) AS p FROM ppl GROUP BY ALL) SELECT dis AS discount, o AS "order", round(p, 4) AS perplexity, round(log2(lag(p) OVER (PARTITION BY dis ORDER BY o)) - log2(p), 5) AS gain FROM m')
def kn_gain_by_discount(spark, sf_dir):
    df = ngram.gains(ngram.kneser_ney(folds(_orders(spark, sf_dir).select("id", "signs"), 5), 3, DISCOUNTS))
    return df.withColumns({"perplexity": F.round("perplexity", 4), "gain": F.round("gain", 5)})


@query(f"""{FOLDS}, v AS (SELECT count(*) + 1 AS v FROM uni), p AS (SELECT he.k,
  (coalesce(g1.n, 0) + 0.5) / (coalesce(t1.t, 0) + 0.5 * v) AS p1, (coalesce(g2.n, 0) + 0.5) / (coalesce(t2.t, 0) + 0.5 * v) AS p2, (coalesce(g3.n, 0) + 0.5) / (coalesce(t3.t, 0) + 0.5 * v) AS p3
  FROM he CROSS JOIN v LEFT JOIN g1 USING (k, w) LEFT JOIN t1 USING (k) LEFT JOIN g2 USING (k, c1, w) LEFT JOIN t2 USING (k, c1) LEFT JOIN g3 USING (k, c1, c2, w) LEFT JOIN t3 USING (k, c1, c2)),
f AS (SELECT 1 AS o, k, pow(2, -avg(log2(p1))) AS x FROM p GROUP BY k UNION ALL SELECT 2, k, pow(2, -avg(log2(p2))) FROM p GROUP BY k UNION ALL SELECT 3, k, pow(2, -avg(log2(p3))) FROM p GROUP BY k)
SELECT o AS "order", round(avg(x), 4) AS perplexity FROM f GROUP BY 1""")
def addalpha_mean_ppl(spark, sf_dir):
    """The mean over the folds."""
    df = ngram.add_alpha(folds(_orders(spark, sf_dir).select("id", "signs"), 5))
    return df.groupBy("order").agg(F.round(F.avg("perplexity"), 4).alias("perplexity"))


def _addalpha_sql(orders: int) -> str:
    """``pa`` (o, k, p): add-alpha perplexities in SQL for any number of orders."""
    ctx = lambda o: "".join(f", c{j}" for j in range(1, o))
    lags = "".join(f", lag(sign, {j}, '<S>') OVER q AS c{j}" for j in range(1, orders))
    parts = [f"x4 AS (SELECT fold, sign AS w{lags} FROM (SELECT id, fold, unnest(signs) AS sign, unnest(range(len(signs))) AS pos FROM fo) WINDOW q AS (PARTITION BY id ORDER BY pos))", "v AS (SELECT count(*) + 1 AS v FROM uni)"]
    parts += [f"y4 AS (SELECT fold, w{ctx(orders)}, count(*) AS n FROM x4 GROUP BY ALL)", f"tr4 AS (SELECT ks.k, w{ctx(orders)}, sum(n) AS n FROM y4 JOIN ks ON fold <> ks.k GROUP BY ALL)", f"he4 AS (SELECT fold AS k, w{ctx(orders)}, n AS held FROM y4 WHERE fold >= 0)"]
    for o in range(1, orders + 1):
        parts.append(f"a{o} AS (SELECT k, w{ctx(o)}, sum(n) AS n FROM tr4 GROUP BY ALL), b{o} AS (SELECT k{ctx(o)}, sum(n) AS t FROM tr4 GROUP BY ALL)")
    each = [f"SELECT {o} AS o, k, pow(2, -sum(held * log2((coalesce(a{o}.n, 0) + 0.5) / (coalesce(b{o}.t, 0) + 0.5 * v))) / sum(held)) AS p FROM he4 CROSS JOIN v LEFT JOIN a{o} USING (k, w{ctx(o)}) LEFT JOIN b{o} USING (k{ctx(o)}) GROUP BY k" for o in range(1, orders + 1)]
    return f"{FOLDS}, " + ", ".join(parts) + ", pa AS (" + " UNION ALL ".join(each) + ")"


@query(f'{_addalpha_sql(4)} SELECT o AS "order", round(avg(p), 4) AS perplexity FROM pa GROUP BY 1')
def addalpha_mean_ppl_to_four(spark, sf_dir):
    """Orders one to four, the mean over the folds."""
    df = ngram.add_alpha(folds(_orders(spark, sf_dir).select("id", "signs"), 5), (1, 2, 3, 4))
    return df.groupBy("order").agg(F.round(F.avg("perplexity"), 4).alias("perplexity"))


def _curve_sql(orders: int, discounts: tuple[float, ...]) -> str:
    """``ppl`` (o, dis, k, p) in SQL for any number of orders: counts by order and fold, then one interpolation after another."""
    ctx = lambda o: "".join(f", c{j}" for j in range(1, o))
    parts = [f"x6 AS (SELECT fold, sign AS w{''.join(f', lag(sign, {j}, chr(60) || chr(83) || chr(62)) OVER q AS c{j}' for j in range(1, orders))} FROM (SELECT id, fold, unnest(signs) AS sign, unnest(range(len(signs))) AS pos FROM fo) WINDOW q AS (PARTITION BY id ORDER BY pos))".replace("chr(60) || chr(83) || chr(62)", "'<S>'")]
    parts += [f"y AS (SELECT fold, w{ctx(orders)}, count(*) AS n FROM x6 GROUP BY ALL)", f"tr6 AS (SELECT ks.k, w{ctx(orders)}, sum(n) AS n FROM y JOIN ks ON fold <> ks.k GROUP BY ALL)", f"he6 AS (SELECT fold AS k, w{ctx(orders)}, n AS held FROM y WHERE fold >= 0)"]
    parts += ["b AS (SELECT DISTINCT k, c1, w FROM tr6), bw AS (SELECT k, w, count(*) AS kinds FROM b GROUP BY ALL), bk AS (SELECT k, count(*) AS kinds FROM b GROUP BY ALL)", f"ds AS (SELECT unnest([{', '.join(map(str, discounts))}])::DOUBLE AS dis)"]
    parts += [f"h{o} AS (SELECT k, w{ctx(o)}, sum(n) AS n FROM tr6 GROUP BY ALL), s{o} AS (SELECT k{ctx(o)}, sum(n) AS t, count(*) AS d FROM h{o} GROUP BY ALL)" for o in range(1, orders + 1)]
    parts.append("q0 AS (SELECT he6.*, dis, coalesce(bw.kinds, 0) / bk.kinds::DOUBLE AS p0 FROM he6 CROSS JOIN ds JOIN bk USING (k) LEFT JOIN bw USING (k, w))")
    for o in range(1, orders + 1):
        parts.append(f"q{o} AS (SELECT q{o - 1}.*, CASE WHEN s{o}.t IS NULL THEN p{o - 1} ELSE greatest(coalesce(h{o}.n, 0) - dis, 0) / s{o}.t::DOUBLE + dis * s{o}.d / s{o}.t::DOUBLE * p{o - 1} END AS p{o} FROM q{o - 1} LEFT JOIN h{o} USING (k, w{ctx(o)}) LEFT JOIN s{o} USING (k{ctx(o)}))")
    parts.append("ppl AS (" + " UNION ALL ".join(f"SELECT {o} AS o, dis, k, pow(2, -sum(held * log2(greatest(p{o}, 1e-12))) / sum(held)) AS p FROM q{orders} GROUP BY ALL" for o in range(1, orders + 1)) + ")")
    return f"{FOLDS}, " + ", ".join(parts)


SWEEP = (0.5, 0.6, 0.7, 0.75, 0.8, 0.9)


@query(f'{_curve_sql(6, (0.75,))}, m AS (SELECT o, dis, avg(p) AS p FROM ppl GROUP BY ALL) SELECT dis AS discount, o AS "order", round(p, 4) AS perplexity, round(log2(lag(p) OVER (PARTITION BY dis ORDER BY o)) - log2(p), 5) AS gain FROM m')
def entropy_curve(spark, sf_dir):
    """Orders one to six: perplexity and the information that each order adds."""
    df = ngram.gains(ngram.kneser_ney(folds(_orders(spark, sf_dir).select("id", "signs"), 5), 6, (0.75,)))
    return df.withColumns({"perplexity": F.round("perplexity", 4), "gain": F.round("gain", 5)})


@query(f"""{_curve_sql(3, SWEEP)}, m AS (SELECT o, dis, avg(p) AS p FROM ppl GROUP BY ALL), g AS (SELECT dis, max(log2(p)) FILTER (o = 1) - max(log2(p)) FILTER (o = 2) AS g2, max(log2(p)) FILTER (o = 2) - max(log2(p)) FILTER (o = 3) AS g3 FROM m GROUP BY 1)
SELECT dis AS discount, round(g2, 5) AS gain_2, round(g3, 5) AS gain_3, g2 > 0 AND g2 > g3 AS holds FROM g""")
def discount_sweep(spark, sf_dir):
    """Six discounts: whether the second order gains, and more than the third, whatever the discount."""
    g = ngram.gains(ngram.kneser_ney(folds(_orders(spark, sf_dir).select("id", "signs"), 5), 3, SWEEP))
    of = lambda k: F.max(F.when(F.col("order") == k, F.col("gain")))
    wide = g.groupBy("discount").agg(of(2).alias("gain_2"), of(3).alias("gain_3"))
    return wide.select("discount", F.round("gain_2", 5).alias("gain_2"), F.round("gain_3", 5).alias("gain_3"), ((F.col("gain_2") > 0) & (F.col("gain_2") > F.col("gain_3"))).alias("holds"))


@query(f"""{WITH}, r AS (SELECT site, id, signs, row_number() OVER (PARTITION BY site ORDER BY md5('0|' || id), id) - 1 AS r, greatest(count(*) OVER (PARTITION BY site) // 3, 1) AS size FROM corpus),
fo AS (SELECT site, id, signs, CASE WHEN r < 3 * size THEN r // size ELSE -1 END AS fold FROM r), x AS (SELECT site, fold, sign AS w, lag(sign, 1, '<S>') OVER (PARTITION BY id ORDER BY pos) AS c1 FROM (SELECT site, id, fold, unnest(signs) AS sign, unnest(range(len(signs))) AS pos FROM fo)),
ks AS (SELECT unnest(range(3)) AS k), tr AS (SELECT site, k, w, c1, count(*) AS n FROM x JOIN ks ON fold <> k GROUP BY ALL), he AS (SELECT site, fold AS k, w, c1, count(*) AS held FROM x WHERE fold >= 0 GROUP BY ALL), v AS (SELECT site, count(DISTINCT w) + 1 AS v FROM x GROUP BY 1),
h1 AS (SELECT site, k, w, sum(n) AS n FROM tr GROUP BY ALL), s1 AS (SELECT site, k, sum(n) AS t FROM tr GROUP BY ALL), s2 AS (SELECT site, k, c1, sum(n) AS t FROM tr GROUP BY ALL),
p AS (SELECT site, k, held, (coalesce(h1.n, 0) + 0.5) / (coalesce(s1.t, 0) + 0.5 * v) AS p1, (coalesce(tr.n, 0) + 0.5) / (coalesce(s2.t, 0) + 0.5 * v) AS p2 FROM he JOIN v USING (site) LEFT JOIN h1 USING (site, k, w) LEFT JOIN s1 USING (site, k) LEFT JOIN tr USING (site, k, w, c1) LEFT JOIN s2 USING (site, k, c1)),
f AS (SELECT site, k, pow(2, -sum(held * log2(p1)) / sum(held)) AS x1, pow(2, -sum(held * log2(p2)) / sum(held)) AS x2 FROM p GROUP BY 1, 2) SELECT site, round(avg(x2) / avg(x1), 5) AS ratio FROM f GROUP BY 1""")
def perplexity_ratio_by_site(spark, sf_dir):
    return ngram.perplexity_ratio(_orders(spark, sf_dir), "site").withColumn("ratio", F.round("ratio", 5))


PAIRS = f"""{WITH}, ch AS (SELECT id, site, object_type, motif, signs, len(signs) AS len, (row_number() OVER (PARTITION BY len(signs) ORDER BY id) - 1) // 400 AS chunk FROM corpus),
ho AS (SELECT * EXCLUDE (signs, p), p - 1 AS position, signs[p] AS sign, signs[1:p-1] AS pre, signs[p+1:] AS suf FROM (SELECT *, unnest(range(1, len(signs) + 1)) AS p FROM ch)),
mp AS (SELECT a.id AS id_a, b.id AS id_b, a.len::INT AS len, a.position::INT AS position, a.sign AS sign_a, b.sign AS sign_b, a.site AS site_a, a.motif AS motif_a,
  a.site = b.site AND a.object_type = b.object_type AND a.site <> 'unknown' AS context, a.site = b.site AND a.object_type = b.object_type AND a.site <> 'unknown' AND a.motif = b.motif AND a.motif <> 'unknown' AS same_motif
  FROM ho a JOIN ho b ON a.len = b.len AND a.chunk = b.chunk AND a.position = b.position AND a.pre = b.pre AND a.suf = b.suf AND a.id < b.id AND a.sign <> b.sign),
ed AS (SELECT least(sign_a, sign_b) AS u, greatest(sign_a, sign_b) AS v, count(*) AS weight, list_sort(list(DISTINCT position)) AS positions, count(DISTINCT (site_a, motif_a)) AS contexts FROM mp GROUP BY 1, 2)"""


def _pairs(spark, sf_dir):
    return substitution.minimal_pairs(_orders(spark, sf_dir))


@query(f"{PAIRS} SELECT len, position, count(*)::BIGINT AS n, count(*) FILTER (context)::BIGINT AS n_context, count(*) FILTER (same_motif)::BIGINT AS n_motif FROM mp GROUP BY 1, 2")
def minimal_pairs_by_position(spark, sf_dir):
    return _pairs(spark, sf_dir).groupBy("len", "position").agg(F.count("*").alias("n"), F.count_if("context").alias("n_context"), F.count_if("same_motif").alias("n_motif"))


@query(f"{PAIRS} SELECT id_a, id_b, len, position, sign_a, sign_b, context, same_motif FROM mp WHERE context")
def minimal_pairs_context(spark, sf_dir):
    return substitution.tier(_pairs(spark, sf_dir), "context").drop("site_a", "motif_a")


@query(f"{PAIRS} SELECT u, v, weight::BIGINT AS weight, array_to_string(positions, ',') AS positions FROM ed")
def substitution_edges(spark, sf_dir):
    return substitution.edges(_pairs(spark, sf_dir)).withColumn("positions", F.array_join(F.transform("positions", lambda x: x.cast("string")), ","))


@query(f"{PAIRS} SELECT u, v, contexts::BIGINT AS distinct_contexts FROM ed")
def distinct_contexts(spark, sf_dir):
    return substitution.distinct_contexts(_pairs(spark, sf_dir))


#: Classes that the motif tier connects: each sign with all that it reaches.
COMPONENTS = f"{PAIRS}, me AS (SELECT least(sign_a, sign_b) AS u, greatest(sign_a, sign_b) AS v FROM mp WHERE same_motif GROUP BY 1, 2), un AS (SELECT u AS s, v AS t FROM me UNION SELECT v, u FROM me)".replace("WITH raw", "WITH RECURSIVE raw", 1) + ", re AS (SELECT s, s AS c FROM un UNION SELECT un.t, re.c FROM re JOIN un ON un.s = re.s)"


@query(COMPONENTS + " SELECT s AS sign, min(c) AS component FROM re GROUP BY 1")
def components(spark, sf_dir):
    """Classes of signs that the motif tier connects."""
    return substitution.classes(substitution.edges(substitution.tier(_pairs(spark, sf_dir), "motif")))


@query(f"{PAIRS}, de AS (SELECT s AS sign, count(*)::BIGINT AS degree FROM (SELECT u AS s FROM ed UNION ALL SELECT v FROM ed) GROUP BY 1) SELECT sign, degree, round(degree / (count(*) OVER () - 1)::DOUBLE, 6) AS centrality FROM de")
def degree_centrality(spark, sf_dir):
    return _rounded(substitution.degree_centrality(substitution.edges(_pairs(spark, sf_dir))), "centrality")


def _motif_edges(c):
    """The graph of all minimal pairs of the motif tier."""
    return substitution.edges(substitution.pair_counts(c, "motif"))


@query()
def modularity_communities(spark, sf_dir):
    """Iterative: tested on a barbell graph. All minimal pairs."""
    return substitution.modularity_classes(_motif_edges(_orders(spark, sf_dir)))


def _components(c):
    """Classes that the motif tier of all minimal pairs connects."""
    return substitution.classes(_motif_edges(c))


def _motif_classes(c):
    return substitution.modularity_classes(_motif_edges(c)).withColumnRenamed("community", "component")


def _by_site(c, classes):
    """Stability by site of the ``classes`` of the motif tier's graph: its pairs agree in their site, so those of all sites together are the whole's, and all come from one mining."""
    pairs, path = materialize(substitution.pair_counts(c, "motif", "site"), "pairs")
    out, _ = materialize(_rounded(substitution.stability_by_part(c, classes(substitution.edges(pairs)), "site", pairs=pairs), "jaccard"), "stability")
    discard(c.sparkSession, path)
    return out


@query()
@over_corpus
def class_stability_by_site(c):
    """Communities of the motif tier against the components of each site's own pairs."""
    return _by_site(c, lambda e: substitution.modularity_classes(e).withColumnRenamed("community", "component"))


STABILITY_TRIALS = 100


def _trials(c, n, trials, seed):
    """The rows that any trial takes, each once, with the bitmap of its trials."""
    return resampling.with_trials(c, n, trials, seed)


@query()
@over_corpus
def class_stability_subsampled(c):
    """Communities of the motif tier against the components of 2000 rows of each of 100 trials (sampling is the feature)."""
    return _rounded(substitution.stability_by_trial(_trials(c, 2000, STABILITY_TRIALS, 9), _motif_classes(c), STABILITY_TRIALS), "jaccard")


@query(COMPONENTS + """, cl AS (SELECT s AS sign, min(c) AS component FROM re GROUP BY 1),
sl AS (SELECT sign, count(*) FILTER (pos = 0) / count(*)::DOUBLE AS fi, count(*) FILTER (pos = len - 1) / count(*)::DOUBLE AS la FROM tok GROUP BY 1),
pr AS (SELECT component, count(*)::BIGINT AS members, round(avg(la), 6) AS mean_final, stddev_pop(la) AS sd, round(avg(fi), 6) AS mean_initial, round(stddev_pop(fi), 6) AS std_initial FROM cl JOIN sl USING (sign) GROUP BY 1),
pl AS (SELECT x.component, position, count(*) AS n FROM mp JOIN cl x ON x.sign = sign_a JOIN cl y ON y.sign = sign_b AND x.component = y.component WHERE len >= 3 GROUP BY 1, 2),
tp AS (SELECT component, n, sum(n) OVER (PARTITION BY component) AS t, position FROM pl QUALIFY row_number() OVER (PARTITION BY component ORDER BY n DESC, position) = 1)
SELECT component, members, mean_final, round(sd, 6) AS std_final, mean_initial, std_initial, coalesce(t, 0)::BIGINT AS n_pairs, position AS top_position, round(n / t::DOUBLE, 6) AS top_share,
  coalesce(n / t::DOUBLE > 0.6 AND t >= 5 AND sd < 0.15, false) AS slot_like FROM pr LEFT JOIN tp USING (component)""")
@over_corpus
def class_positions(c):
    """Where the classes that the motif tier connects stand in their rows."""
    runs, path = materialize(substitution.in_runs(c), "runs")
    (every, one), (motif, two) = (materialize(substitution.pair_counts(runs, name, within=("chunk",)), "pairs") for name in ("all", "motif"))
    found, _ = materialize(substitution.class_positions(every, substitution.classes(substitution.edges(motif)), stats.slot_counts(c)), "positions")
    discard(c.sparkSession, path, one, two)
    return _rounded(found, "mean_final", "std_final", "mean_initial", "std_initial", "top_share")


#: The cut that the SQL above makes: rows meet only in the same run of 400 of their length, by id.
RUNS = "(row_number() OVER (PARTITION BY len(signs) ORDER BY id) - 1) // 400 AS chunk"


def whole(f: Callable) -> Callable:
    """Register ``NAME_whole``: the query NAME over all minimal pairs, against NAME's SQL without runs of 400."""
    sql = _registry[f.__name__.removesuffix("_whole")][1]
    assert RUNS in sql
    return query(sql.replace(RUNS, "0 AS chunk"))(f)


@whole
@over_corpus
def minimal_pairs_by_position_whole(c):
    of = lambda t: F.coalesce(F.sum(F.when(F.col("tier") == t, F.col("n"))), F.lit(0))
    return substitution.tier_counts(c).groupBy("len", "position").agg(of("all").alias("n"), of("context").alias("n_context"), of("motif").alias("n_motif"))


@whole
def minimal_pairs_context_whole(spark, sf_dir):
    """The pairs themselves: their number is quadratic by nature."""
    p = substitution.minimal_pairs(_orders(spark, sf_dir), None, same=("site", "object_type"))
    return substitution.tier(p, "context").drop("site_a", "motif_a")


@whole
def substitution_edges_whole(spark, sf_dir):
    e = substitution.edges(substitution.pair_counts(_orders(spark, sf_dir)))
    return e.withColumn("positions", F.array_join(F.transform("positions", lambda x: x.cast("string")), ","))


@whole
def distinct_contexts_whole(spark, sf_dir):
    return substitution.distinct_contexts_whole(_orders(spark, sf_dir))


@whole
def components_whole(spark, sf_dir):
    return _components(_orders(spark, sf_dir))


@whole
def degree_centrality_whole(spark, sf_dir):
    return _rounded(substitution.degree_centrality(substitution.edges(substitution.pair_counts(_orders(spark, sf_dir)))), "centrality")


@whole
@over_corpus
def class_positions_whole(c):
    found = substitution.class_positions(substitution.pair_counts(c), substitution.classes(_motif_edges(c)), stats.slot_counts(c))
    return _rounded(found, "mean_final", "std_final", "mean_initial", "std_initial", "top_share")


WHOLE = PAIRS.replace(RUNS, "0 AS chunk")
CLASSES = COMPONENTS.replace(RUNS, "0 AS chunk") + ", cl AS (SELECT s AS sign, min(c) AS component FROM re GROUP BY 1)"


def _stability_sql(trials: str, out: str) -> str:
    """``jc`` (trial, class, members, jaccard) of the components ``cl`` in the rows ``tr`` (trial, and those of the corpus)."""
    return f"""{CLASSES}, tr AS ({trials}), th AS (SELECT trial, site, object_type, motif, len(signs) AS len, p, signs[p] AS sign, signs[1:p-1] AS pre, signs[p+1:] AS suf FROM (SELECT *, unnest(range(1, len(signs) + 1)) AS p FROM tr) WHERE motif <> 'unknown' AND site <> 'unknown'),
hd AS (SELECT DISTINCT * FROM th), te AS (SELECT DISTINCT a.trial, a.sign AS s, b.sign AS t FROM hd a JOIN hd b ON a.trial = b.trial AND a.site = b.site AND a.object_type = b.object_type AND a.motif = b.motif AND a.len = b.len AND a.p = b.p AND a.pre = b.pre AND a.suf = b.suf AND a.sign <> b.sign),
tc AS (SELECT trial, s, s AS c FROM te UNION SELECT te.trial, te.t, tc.c FROM tc JOIN te ON te.trial = tc.trial AND te.s = tc.s), tp AS (SELECT trial, s AS sign, min(c) AS part FROM tc GROUP BY 1, 2),
vo AS (SELECT DISTINCT trial, unnest(signs) AS sign FROM tr), he AS (SELECT trial, cl.component AS class, sign FROM vo JOIN cl USING (sign)), hs AS (SELECT trial, class, count(*) AS members FROM he GROUP BY 1, 2 HAVING count(*) > 1), ps AS (SELECT trial, part, count(*) AS n FROM tp GROUP BY 1, 2),
bo AS (SELECT trial, class, part, count(*) AS common FROM he JOIN tp USING (trial, sign) GROUP BY 1, 2, 3), ja AS (SELECT trial, class, max(common / (members + ps.n - common)::DOUBLE) AS jaccard FROM bo JOIN ps USING (trial, part) JOIN hs USING (trial, class) GROUP BY 1, 2),
jc AS (SELECT hs.trial, hs.class, hs.members, coalesce(jaccard, 0) AS jaccard FROM hs LEFT JOIN ja USING (trial, class)) {out}"""


@query(_stability_sql(f"SELECT t AS trial, id, signs, site, object_type, motif FROM corpus CROSS JOIN (SELECT unnest(range({STABILITY_TRIALS})) AS t) QUALIFY row_number() OVER (PARTITION BY t ORDER BY md5(t || '|9|' || id), id) <= 2000", "SELECT trial::INT AS trial, class, members::BIGINT AS members, round(jaccard, 6) AS jaccard FROM jc"))
@over_corpus
def component_stability_subsampled(c):
    """Components of the motif tier against those of 2000 rows of each of 100 trials (sampling is the feature), all trials mined at once."""
    return _rounded(substitution.stability_by_trial(_trials(c, 2000, STABILITY_TRIALS, 9), _components(c), STABILITY_TRIALS), "jaccard")


@query(_stability_sql("SELECT site AS trial, id, signs, site, object_type, motif FROM corpus", "SELECT trial AS site, class, members::BIGINT AS members, round(jaccard, 6) AS jaccard FROM jc"))
@over_corpus
def component_stability_by_site(c):
    """Components of the motif tier against those of each site's own pairs."""
    return _by_site(c, substitution.classes)


#: The sites of most and of fewest rows with a motif, and those rows' number at the latter.
_MATCHED = "(SELECT site, count(*) AS n FROM corpus WHERE motif <> 'unknown' GROUP BY 1)"


@query(_stability_sql(f"""SELECT -1 AS trial, id, signs, site, object_type, motif FROM corpus WHERE site = (SELECT site FROM {_MATCHED} ORDER BY n, site LIMIT 1) UNION ALL
SELECT t, id, signs, site, object_type, motif FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY md5(t || '|4|' || id), id) AS r FROM corpus CROSS JOIN (SELECT unnest(range({STABILITY_TRIALS})) AS t) WHERE site = (SELECT site FROM {_MATCHED} ORDER BY n DESC, site LIMIT 1)) WHERE r <= (SELECT min(n) FROM {_MATCHED})""",
    """SELECT h.class, h.members::BIGINT AS members, round(h.jaccard, 6) AS jaccard, round(avg(s.jaccard), 6) AS mean, round(min(s.jaccard), 6) AS low, round(max(s.jaccard), 6) AS high, count(s.jaccard)::BIGINT AS trials, h.jaccard >= min(s.jaccard) AS explained, min(s.jaccard) = 0 AS vacuous
FROM jc h LEFT JOIN jc s ON s.class = h.class AND s.trial >= 0 WHERE h.trial = -1 GROUP BY h.class, h.members, h.jaccard"""))  # fmt: skip
@over_corpus
def matched_size_call(c):
    """Whether the size of the smallest site explains how its components differ from the whole's: against 100 samples as small of the largest site."""
    counts = c.where("motif <> 'unknown'").groupBy("site").agg(F.count("*").alias("n"))
    small, large = counts.orderBy("n", "site").first(), counts.orderBy(F.desc("n"), "site").first()
    whole = _components(c)
    here = substitution.stability_by_part(c.where(F.col("site") == small["site"]), whole, "site")
    sampled = substitution.stability_by_trial(_trials(c.where(F.col("site") == large["site"]), small["n"], STABILITY_TRIALS, 4), whole, STABILITY_TRIALS)
    return _rounded(substitution.matched_size(here, sampled), "jaccard", "mean", "low", "high")


@query(f"""{CLASSES}, ex AS (SELECT component, sign_a || '>' || sign_b AS x, row_number() OVER (PARTITION BY component ORDER BY id_a, id_b, position) AS r FROM mp JOIN cl ON sign = sign_a WHERE same_motif)
SELECT component, size, signs, examples FROM (SELECT component, count(*)::BIGINT AS size, string_agg(sign, ',' ORDER BY sign) AS signs FROM cl GROUP BY 1) JOIN (SELECT component, string_agg(x, ',' ORDER BY r) AS examples FROM ex WHERE r <= 5 GROUP BY 1) USING (component)""")
@over_corpus
def class_summaries(c):
    """Classes of the motif tier with their first five pairs."""
    found = substitution.summaries(substitution.first_pairs(c, "motif"), _components(c))
    return found.select("component", "size", F.array_join("signs", ",").alias("signs"), F.array_join("examples", ",").alias("examples"))


@query(f"""{CLASSES} SELECT (SELECT count(*) FROM corpus)::BIGINT AS n, (SELECT count(*) FILTER (motif <> 'unknown') FROM corpus)::BIGINT AS n_known_motif, (SELECT count(*) FROM mp)::BIGINT AS n_pairs, (SELECT count(*) FROM mp WHERE context)::BIGINT AS n_context, (SELECT count(*) FROM mp WHERE same_motif)::BIGINT AS n_motif,
  (SELECT count(*) FROM ed)::BIGINT AS n_edges, (SELECT count(*) FROM me)::BIGINT AS n_motif_edges, (SELECT count(DISTINCT component) FROM cl)::BIGINT AS n_classes, (SELECT max(n) FROM (SELECT count(*) AS n FROM cl GROUP BY component))::BIGINT AS largest""")
@over_corpus
def pair_report(c):
    """Minimal pairs, graph and classes in one row."""
    one = c.agg(F.count("*").alias("n"), F.count_if(F.col("motif") != "unknown").alias("n_known_motif"))
    every, path = materialize(substitution.tier_counts(c), "pairs")
    mined = {t: every.where(F.col("tier") == t) for t in ("all", "context", "motif")}
    for name, tier in (("n_pairs", "all"), ("n_context", "context"), ("n_motif", "motif")):
        one = one.join(F.broadcast(mined[tier].agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))))
    motif = substitution.edges(mined["motif"])
    sizes = substitution.classes(motif).groupBy("component").agg(F.count("*").alias("size"))
    for df in (substitution.edges(mined["all"]).agg(F.count("*").alias("n_edges")), motif.agg(F.count("*").alias("n_motif_edges")), sizes.agg(F.count("*").alias("n_classes"), F.max("size").alias("largest"))):
        one = one.join(F.broadcast(df))
    out, _ = materialize(one, "report")
    discard(c.sparkSession, path)
    return out


@query(f"{WHOLE} SELECT u, v, contexts::BIGINT AS distinct_contexts FROM ed ORDER BY 3 DESC, 1, 2 LIMIT 10")
def edges_by_contexts(spark, sf_dir):
    """A top-10 report."""
    return substitution.distinct_contexts_whole(_orders(spark, sf_dir)).orderBy(F.desc("distinct_contexts"), "u", "v").limit(10)


@query(f"{CLASSES} SELECT component, count(*)::BIGINT AS size FROM cl GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
@over_corpus
def largest_classes(c):
    """A top-5 report of the classes that the motif tier connects."""
    return _components(c).groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(5)


@query(_registry["degree_centrality_whole"][1] + " ORDER BY centrality DESC, sign LIMIT 10")
def central_signs(spark, sf_dir):
    """A top-10 report."""
    return degree_centrality_whole(spark, sf_dir).orderBy(F.desc("centrality"), "sign").limit(10)


@query(f"{CLASSES} SELECT x.component, position, count(*)::BIGINT AS n FROM mp JOIN cl x ON x.sign = sign_a JOIN cl y ON y.sign = sign_b AND x.component = y.component WHERE len >= 3 GROUP BY 1, 2")
@over_corpus
def class_position_histogram(c):
    """At which positions the pairs within each class of the motif tier differ, in rows of three signs or more."""
    return substitution.class_places(substitution.pair_counts(c), substitution.classes(_motif_edges(c)))


@query(_registry["llr_bigrams"][1] + " ORDER BY g2 DESC, a, b LIMIT 10")
def llr_top(spark, sf_dir):
    """A top-10 report."""
    return llr_bigrams(spark, sf_dir).orderBy(F.desc("g2"), "a", "b").limit(10)


@query()
@over_corpus
def class_corroboration(c):
    """Whether communities of substitutable signs are alike in what stands beside them: mean cosine of PPMI rows against 200 sets drawn by hash."""
    found = substitution.corroborated(_motif_classes(c), vectors.rows_of(vectors.ppmi(vectors.cooccurrence(c))), 200, 3)
    return _rounded(found, "similarity", "baseline")


def _corroborated_sql(head: str, rows: str) -> str:
    """The same of classes ``cl`` (sign, component) by the PPMI rows of ``rows`` (id, pos, sign)."""
    return f"""{head}, co AS (SELECT x.sign AS a, y.sign AS b, count(*) AS n FROM {rows} x JOIN {rows} y ON x.id = y.id AND y.pos BETWEEN x.pos - 2 AND x.pos + 2 AND x.pos <> y.pos GROUP BY 1, 2),
pp AS (SELECT a, b, greatest(0, log2(n * sum(n) OVER () / (sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b))::DOUBLE)) AS x FROM co), nr AS (SELECT a, sqrt(sum(x * x)) AS r FROM pp GROUP BY 1),
si AS (SELECT p.a AS s, q.a AS t, sum(p.x * q.x) / (any_value(m.r) * any_value(w.r)) AS c FROM pp p JOIN pp q ON p.b = q.b AND p.a < q.a JOIN nr m ON m.a = p.a JOIN nr w ON w.a = q.a WHERE m.r > 0 AND w.r > 0 GROUP BY 1, 2),
me2 AS (SELECT component, sign FROM cl JOIN nr ON a = sign), ms AS (SELECT component, count(*) AS k FROM me2 GROUP BY 1 HAVING count(*) > 1), sm AS (SELECT x.component, sum(c) AS c FROM si JOIN me2 x ON x.sign = s JOIN me2 y ON y.sign = t AND y.component = x.component GROUP BY 1),
li AS (SELECT d, sign, row_number() OVER (PARTITION BY d ORDER BY md5('3|' || d || '|' || sign), sign) AS place FROM (SELECT a AS sign FROM nr) CROSS JOIN (SELECT unnest(range(200)) AS d)),
ba AS (SELECT k, x.d, sum(c) AS c FROM (SELECT DISTINCT k FROM ms) JOIN li x ON x.place <= k JOIN li y ON y.d = x.d AND y.place <= k JOIN si ON s = x.sign AND t = y.sign GROUP BY k, x.d), bs AS (SELECT k, sum(c) / 200 AS c FROM ba GROUP BY 1),
fi AS (SELECT ms.component, k, coalesce(sm.c, 0) * 2 / (k * (k - 1)) AS similarity, coalesce(bs.c, 0) * 2 / (k * (k - 1)) AS baseline FROM ms LEFT JOIN sm USING (component) LEFT JOIN bs USING (k))
SELECT component, k::BIGINT AS members, round(similarity, 6) AS similarity, round(baseline, 6) AS baseline, similarity > baseline + 1e-9 AS corroborated FROM fi"""


@query(_corroborated_sql(CLASSES, "tok"))
@over_corpus
def component_corroboration(c):
    """The same of the components of the motif tier."""
    return _rounded(substitution.corroborated(_components(c), vectors.rows_of(vectors.ppmi(vectors.cooccurrence(c))), 200, 3), "similarity", "baseline")


_BY_SIZE = "(SELECT site, count(*) AS n FROM corpus GROUP BY 1)"


@query(_corroborated_sql(f"{WHOLE}, sx AS (SELECT least(sign_a, sign_b) AS u, greatest(sign_a, sign_b) AS v FROM mp WHERE same_motif AND site_a = (SELECT site FROM {_BY_SIZE} ORDER BY n DESC, site LIMIT 1) GROUP BY 1, 2), un AS (SELECT u AS s, v AS t FROM sx UNION SELECT v, u FROM sx)".replace("WITH raw", "WITH RECURSIVE raw", 1)
    + f", re AS (SELECT s, s AS c FROM un UNION SELECT un.t, re.c FROM re JOIN un ON un.s = re.s), cl AS (SELECT s AS sign, min(c) AS component FROM re GROUP BY 1), t2 AS (SELECT id, pos, sign FROM tok WHERE site = (SELECT site FROM {_BY_SIZE} ORDER BY n DESC, site LIMIT 1 OFFSET 1))", "t2"))
@over_corpus
def cross_site_corroboration(c):
    """Components found at the largest site, judged by what stands beside their signs at the second largest."""
    first, second = (r["site"] for r in c.groupBy("site").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "site").limit(2).collect())
    at = lambda site: c.where(F.col("site") == site)
    found = substitution.classes(_motif_edges(at(first)))
    return _rounded(substitution.corroborated(found, vectors.rows_of(vectors.ppmi(vectors.cooccurrence(at(second)))), 200, 3), "similarity", "baseline")


def _joined(df):
    return df.select("id", F.array_join("signs", " ").alias("signs"))


@query(f"{WITH} SELECT id, string_agg(sign, ' ' ORDER BY md5('7|' || id || '|' || pos), pos) AS signs FROM tok GROUP BY 1")
def within_shuffle(spark, sf_dir):
    return _joined(nulls.within_shuffle(_orders(spark, sf_dir), 7))


@query(f"{WITH} SELECT id, string_agg(sign, ' ' ORDER BY CASE WHEN len < 3 THEN lpad(pos::VARCHAR, 9, '0') WHEN pos = 0 THEN '' WHEN pos = len - 1 THEN '~' ELSE md5('7|' || id || '|' || pos) END, pos) AS signs FROM tok GROUP BY 1")
def position_preserving_shuffle(spark, sf_dir):
    return _joined(nulls.position_preserving_shuffle(_orders(spark, sf_dir), 7))


@query(f"""{WITH}, pl AS (SELECT id, pos, row_number() OVER (ORDER BY id, pos) AS r FROM tok), sg AS (SELECT sign, row_number() OVER (ORDER BY md5('7|' || id || '|' || pos), id, pos) AS r FROM tok)
SELECT id, string_agg(sign, ' ' ORDER BY pos) AS signs FROM pl JOIN sg USING (r) GROUP BY 1""")
def global_shuffle(spark, sf_dir):
    return _joined(nulls.global_shuffle(_orders(spark, sf_dir), 7))


@query(f"""{WITH}, f AS (SELECT t AS trial, id FROM corpus CROSS JOIN (SELECT unnest(range(3)) AS t)), k AS (SELECT trial::INT AS trial, id, row_number() OVER (PARTITION BY trial ORDER BY md5(trial || '|3|' || id), id) AS r FROM f) SELECT trial, id FROM k WHERE r <= 500""")
def subsample(spark, sf_dir):
    """500 rows of each of three trials: sampling is the feature."""
    return nulls.subsample(_orders(spark, sf_dir), 500, 3, 3).select("trial", "id")


@query(f"{WITH} SELECT id, ('0x' || substr(md5('u|' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM corpus")
def portable_uniform(spark, sf_dir):
    return _orders(spark, sf_dir).select("id", uniform("u", F.col("id")).alias("u"))


def _u(*parts: str) -> str:
    """A hashed number from 0 to 1 in SQL."""
    return f"('0x' || substr(md5({' || chr(124) || '.join(parts)}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def _drawn(stratum: str, n: int | str, seed: int, corpus: str = "corpus") -> str:
    """``nl`` (k, stratum, signs) in SQL: rows drawn from the marginals of their stratum, or the pooled ones."""
    u = lambda *parts: _u(f"'{seed}'", *parts)
    return f"""sc AS (SELECT signs, {stratum} AS stratum FROM {corpus}), ss AS (SELECT stratum, count(*) AS n, CASE WHEN count(*) >= 20 THEN stratum ELSE '__pooled__' END AS source FROM sc GROUP BY 1),
so AS (SELECT stratum AS source, signs FROM sc UNION ALL SELECT '__pooled__', signs FROM sc),
mg AS (SELECT source, 'len' AS kind, lpad(len(signs)::VARCHAR, 6, '0') AS sign FROM so UNION ALL SELECT source, 'first', signs[1] FROM so UNION ALL SELECT source, 'last', signs[-1] FROM so WHERE len(signs) > 1 UNION ALL SELECT source, 'any', unnest(signs) FROM so
  UNION ALL SELECT '', 'stratum', stratum FROM sc),
iv AS (SELECT *, hi - n AS lo FROM (SELECT source, kind, sign, n, sum(n) OVER (PARTITION BY source, kind ORDER BY sign ROWS UNBOUNDED PRECEDING) AS hi, sum(n) OVER (PARTITION BY source, kind) AS total FROM (SELECT source, kind, sign, count(*) AS n FROM mg GROUP BY ALL))),
nk AS (SELECT k, {u("'stratum'", "k")} AS u0, {u("'length'", "k")} AS u1 FROM (SELECT unnest(range({n})) AS k)),
ns AS (SELECT k, u1, sign AS stratum, ss.source FROM nk JOIN iv ON kind = 'stratum' AND floor(u0 * total) >= lo AND floor(u0 * total) < hi JOIN ss ON ss.stratum = sign),
nn AS (SELECT k, stratum, ns.source, sign::INT AS len FROM ns JOIN iv ON iv.source = ns.source AND kind = 'len' AND floor(u1 * total) >= lo AND floor(u1 * total) < hi),
np AS (SELECT k, stratum, source, pos, CASE WHEN pos = 0 THEN 'first' WHEN pos = len - 1 THEN 'last' ELSE 'any' END AS kind, {u("'sign'", "k", "pos")} AS u FROM (SELECT *, unnest(range(len)) AS pos FROM nn)),
nl AS (SELECT k, stratum, list(sign ORDER BY pos) AS signs FROM np JOIN iv ON iv.source = np.source AND iv.kind = np.kind AND floor(u * total) >= lo AND floor(u * total) < hi GROUP BY 1, 2)"""


def _null_sql(stratum: str) -> str:
    return f"{WITH}, {_drawn(stratum, 2000, 42)} SELECT format('NULL-{{:05d}}', k) AS id, array_to_string(signs, ' ') AS signs FROM nl"


@query(_null_sql("'all'"))
def matched_null(spark, sf_dir):
    return _joined(nulls.matched_null(_orders(spark, sf_dir), 2000, 42))


@query(_null_sql("concat_ws('|', site, motif)"))
def stratified_null(spark, sf_dir):
    return _joined(nulls.matched_null(_orders(spark, sf_dir), 2000, 42, F.concat_ws("|", "site", source.broad_motif(F.col("motif")))))


@query(_null_sql("site"))
def site_null(spark, sf_dir):
    return _joined(nulls.matched_null(_orders(spark, sf_dir), 2000, 42, F.col("site")))


@query(_null_sql("motif"))
def motif_null(spark, sf_dir):
    return _joined(nulls.matched_null(_orders(spark, sf_dir), 2000, 42, source.broad_motif(F.col("motif"))))


NULL_TRIALS = 200


@query(f"""{WITH}, {_drawn("'all'", f"(SELECT {NULL_TRIALS} * count(*) FROM corpus)", 5)}, re AS (SELECT count(*) AS n, count(DISTINCT signs) / count(*)::DOUBLE AS x FROM corpus),
tr AS (SELECT k // n AS trial, count(DISTINCT signs) / count(*)::DOUBLE AS x FROM nl CROSS JOIN re GROUP BY 1)
SELECT count(*)::BIGINT AS n, round(avg(tr.x), 6) AS mean, round(min(tr.x), 6) AS low, round(max(tr.x), 6) AS high, round(stddev_pop(tr.x), 6) AS sd, round(any_value(re.x), 6) AS real, round(avg((tr.x >= re.x)::INT::DOUBLE), 6) AS p_value FROM tr CROSS JOIN re""")
def uniqueness_against_null_trials(spark, sf_dir):
    """Uniqueness of the corpus against 200 null corpora of as many rows."""
    c = _orders(spark, sf_dir)
    rows, path = materialize(counted(c.select("signs"), "signs"), "rows")
    real, _ = materialize(rows.agg((F.count("*") / F.sum("n")).alias("real_")), "real")
    trials = nulls.matched_null_uniqueness(c, NULL_TRIALS, seed=5, counts=rows).join(F.broadcast(real))
    discard(spark, path)
    return _rounded(resampling.over_trials(trials, "uniqueness", F.col("real_")), "mean", "low", "high", "sd", "real", "p_value")


@query(f"""{WITH}, f AS (SELECT t AS trial, id, signs FROM corpus CROSS JOIN (SELECT unnest(range(8)) AS t) QUALIFY row_number() OVER (PARTITION BY t ORDER BY md5(t || '|0|' || id), id) <= 500),
g AS (SELECT trial, id, unnest(signs) AS sign, unnest(range(len(signs))) AS pos FROM f), sh AS (SELECT trial, id, list(sign ORDER BY md5('3|' || id || '|' || pos), pos) AS signs FROM g GROUP BY 1, 2),
al AS (SELECT 'real' AS label, trial, signs FROM f UNION ALL SELECT 'within', trial, signs FROM sh),
bg AS (SELECT label, trial, a, b, count(*) AS n FROM (SELECT label, trial, unnest(signs[:-2]) AS a, unnest(signs[2:]) AS b FROM al WHERE len(signs) > 1) GROUP BY ALL),
en AS (SELECT label, trial, -sum(n / t::DOUBLE * log2(n / m::DOUBLE)) AS entropy FROM (SELECT label, trial, n, sum(n) OVER (PARTITION BY label, trial, a) AS m, sum(n) OVER (PARTITION BY label, trial) AS t FROM bg) GROUP BY 1, 2),
un AS (SELECT label, trial, count(DISTINCT signs) / count(*)::DOUBLE AS uniqueness, avg(len(signs)) AS mean_len FROM al GROUP BY 1, 2),
fe AS (SELECT label, avg(entropy) AS entropy, avg(uniqueness) AS uniqueness, avg(mean_len) AS mean_len FROM en JOIN un USING (label, trial) GROUP BY 1),
lo AS (UNPIVOT fe ON entropy, uniqueness, mean_len INTO NAME feature VALUE mean)
SELECT n.label, n.feature, round(n.mean, 6) AS mean, round(r.mean, 6) AS real_mean, round(abs(r.mean - n.mean) / (abs(r.mean) + 1e-9) * 100, 4) AS pct_diff FROM lo n JOIN lo r ON n.feature = r.feature AND r.label = 'real' AND n.label <> 'real'""")
def feature_differences(spark, sf_dir):
    """Mean features of eight samples of 500 rows and of their shuffles: how far the shuffle moves each."""
    sample = nulls.subsample(_orders(spark, sf_dir), 500, 8, 0).select("trial", "id", "signs")
    every = sample.withColumn("label", F.lit("real")).unionByName(nulls.within_shuffle(sample, 3).withColumn("label", F.lit("within")))
    keys = ("label", "trial")
    f = stats.conditional_entropy(every, *keys).join(stats.uniqueness(every, *keys).select(*keys, "uniqueness"), list(keys)).join(stats.summary(every, *keys).select(*keys, "mean_len"), list(keys))
    d = resampling.differences(f, "label", "real", ["entropy", "uniqueness", "mean_len"])
    return _rounded(d, "mean", "real_mean").withColumn("pct_diff", F.round("pct_diff", 4))


def _markov_sql(order: int, seed: int = 42, longest: int = 40) -> str:
    """Markov chains with the same draws, a recursion a sign; at order 2 all but the first step of a chain begun with one sign have two signs to go on from."""
    u = lambda *parts: _u(f"'{seed}'", *parts)
    within = lambda c: f"floor({c} * total) >= lo AND floor({c} * total) < hi"
    laid = lambda name, counts, *keys: f"{name} AS (SELECT *, hi - n AS lo FROM (SELECT *, sum(n) OVER ({f'PARTITION BY {chr(44).join(keys)} ' if keys else ''}ORDER BY sign ROWS UNBOUNDED PRECEDING) AS hi, sum(n) OVER ({f'PARTITION BY {chr(44).join(keys)}' if keys else ''}) AS total FROM ({counts})))"
    parts = ["en AS (SELECT list_append(signs, '<END>') AS s FROM corpus)", laid("i1", "SELECT c1, sign, count(*) AS n FROM (SELECT unnest(s[:-2]) AS c1, unnest(s[2:]) AS sign FROM en) GROUP BY ALL", "c1"), laid("f1", "SELECT signs[1] AS sign, count(*) AS n FROM corpus GROUP BY 1"), "ks AS (SELECT unnest(range((SELECT count(*) FROM corpus))) AS k)"]
    one = f"SELECT k, 0 AS pos, NULL::VARCHAR AS c2, sign AS c1 FROM ks JOIN f1 ON {within(u(chr(39) + 'first' + chr(39), 'k'))}"
    step = u("'step'", "k", "pos + 1")
    if order == 1:
        again = f"SELECT k, pos + 1, NULL, sign FROM ch JOIN i1 ON i1.c1 = ch.c1 AND {within(step)} WHERE ch.c1 <> '<END>' AND pos + 1 < {longest}"
    else:
        parts += [laid("i2", "SELECT c2, c1, sign, count(*) AS n FROM (SELECT unnest(s[:-3]) AS c2, unnest(s[2:-2]) AS c1, unnest(s[3:]) AS sign FROM en) GROUP BY ALL", "c2", "c1"), laid("f2", "SELECT signs[1] || chr(31) || signs[2] AS sign, count(*) AS n FROM corpus WHERE len(signs) > 1 GROUP BY 1"), "i3 AS (SELECT c2, c1, sign, lo, hi, total FROM i2 UNION ALL SELECT '', c1, sign, lo, hi, total FROM i1)"]
        paired = f"{u(chr(39) + 'paired' + chr(39), 'k')} < 0.9"
        one = f"{one} WHERE NOT {paired} UNION ALL SELECT k, 1, split_part(sign, chr(31), 1), split_part(sign, chr(31), 2) FROM ks JOIN f2 ON {within(u(chr(39) + 'pair' + chr(39), 'k'))} WHERE {paired}"
        again = f"SELECT k, pos + 1, ch.c1, sign FROM ch JOIN i3 ON i3.c1 = ch.c1 AND i3.c2 = coalesce(ch.c2, '') AND {within(step)} WHERE ch.c1 <> '<END>' AND pos + 1 < {longest}"
    recursive = f"{WITH}, ".replace("WITH raw", "WITH RECURSIVE raw", 1) + ", ".join(parts) + f", ch AS (SELECT * FROM ({one}) UNION ALL {again})"
    return f"{recursive}, al AS (SELECT k, pos, c1 AS sign FROM ch UNION ALL SELECT k, 0, c2 FROM ch WHERE pos = 1 AND c2 IS NOT NULL AND k NOT IN (SELECT k FROM ch WHERE pos = 0)) SELECT format('MARKOV-{{:05d}}', k) AS id, string_agg(sign, ' ' ORDER BY pos) AS signs FROM al WHERE sign <> '<END>' GROUP BY k"


@query(_markov_sql(1))
def bigram_markov_null(spark, sf_dir):
    """As many chains as the corpus has rows."""
    c = _orders(spark, sf_dir)
    return _joined(nulls.markov_null(c, c.count(), 1, 42))


@query(_markov_sql(2))
@over_corpus
def trigram_markov_null(c):
    """As many chains as the corpus has rows."""
    return _joined(nulls.markov_null(c, c.count(), 2, 42))


def _controls_sql(seed: int = 0) -> str:
    """``en`` (label, entropy, n_bigrams) of the corpus and of a uniform and a rigid control of its size, drawn alike."""
    u = lambda *parts: _u(f"'{seed}'", *parts)
    normal = f"sqrt(-2 * ln(greatest({u(chr(39) + 'a' + chr(39), 'k')}, 1e-9))) * cos(2 * pi() * {u(chr(39) + 'b' + chr(39), 'k')})"
    return f"""{WITH}, ct AS (SELECT (SELECT count(*) FROM uni) AS v, count(*) AS n, avg(len(signs)) AS m FROM corpus), ks AS (SELECT unnest(range((SELECT n FROM ct))) AS k),
ra AS (SELECT k, greatest(1, round(m + 1.5 * {normal}))::INT AS len, v FROM ks CROSS JOIN ct), rg AS (SELECT k, floor({u("'t'", "k")} * 5)::INT AS t, greatest(1, round_even(m, 0))::INT AS len, v FROM ks CROSS JOIN ct),
tk AS (SELECT 'random' AS label, k, i, 'R' || floor({u("k", "i")} * v)::BIGINT AS sign FROM (SELECT *, unnest(range(1, len + 1)) AS i FROM ra) UNION ALL SELECT 'rigid', k, i, 'F' || floor({u("'f'", "t", "i")} * v)::BIGINT FROM (SELECT *, unnest(range(1, len + 1)) AS i FROM rg)),
pr AS (SELECT 'corpus' AS label, a, b FROM pairs UNION ALL SELECT label, sign, lead(sign) OVER (PARTITION BY label, k ORDER BY i) FROM tk),
en AS (SELECT label, -sum(n / t::DOUBLE * log2(n / m::DOUBLE)) AS entropy, sum(n) AS n_bigrams FROM (SELECT label, n, sum(n) OVER (PARTITION BY label, a) AS m, sum(n) OVER (PARTITION BY label) AS t FROM (SELECT label, a, b, count(*) AS n FROM pr WHERE b IS NOT NULL GROUP BY ALL)) GROUP BY 1)"""


@query(f"{_controls_sql()} SELECT label, round(entropy, 6) AS entropy, n_bigrams::BIGINT AS n_bigrams FROM en")
def entropy_against_controls(spark, sf_dir):
    """Conditional entropy beside a uniform and a rigid control of the same size."""
    c = _orders(spark, sf_dir).select("id", "signs")
    s = stats.summary(c).first()
    rows = [c.select(F.lit("corpus").alias("label"), F.col("id").cast("string").alias("id"), "signs")]
    rows += [x.select(F.lit(k).alias("label"), "id", "signs") for k, x in (("random", nulls.uniform_control(spark, s["n_signs"], s["n"], s["mean_len"])), ("rigid", nulls.rigid_control(spark, s["n_signs"], s["n"], s["mean_len"])))]
    return _rounded(stats.conditional_entropy(reduce(DataFrame.unionByName, rows), "label"), "entropy")


CO = f"""{WITH}, co AS (SELECT x.sign AS a, y.sign AS b, count(*) AS n FROM tok x JOIN tok y ON x.id = y.id AND y.pos BETWEEN x.pos - 2 AND x.pos + 2 AND x.pos <> y.pos GROUP BY 1, 2)"""


@query(f"{CO} SELECT a, b, n::BIGINT AS n FROM co")
def cooccurrence(spark, sf_dir):
    return vectors.cooccurrence(_orders(spark, sf_dir))


@query(f"{CO} SELECT a, b, round(greatest(0, log2(n * sum(n) OVER () / (sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b))::DOUBLE)), 6) AS ppmi FROM co")
def ppmi(spark, sf_dir):
    return _rounded(vectors.ppmi(vectors.cooccurrence(_orders(spark, sf_dir))), "ppmi")


@query()
def sign_neighbours(spark, sf_dir):
    """Signs nearest in the PPMI embedding; signs of an SVD are arbitrary, so tested by cosines."""
    e = vectors.embed(vectors.ppmi(vectors.cooccurrence(_orders(spark, sf_dir))))
    return vectors.cosine_neighbours(e, e, "sign", "vector", 5)


@query("""WITH s AS (SELECT q.vec_id AS query, b.vec_id, round(list_sum(list_transform(list_zip(q.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / (sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x)))), 6) AS similarity
FROM embeddings q JOIN embeddings b ON q.vec_id % 100 = 0 AND q.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id)::INT AS rank FROM s) SELECT query, vec_id, similarity, rank FROM r WHERE rank <= 5""")
def cosine_knn(spark, sf_dir):
    """The stated queries (ids divisible by 100) against all rows."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vectors.cosine_neighbours(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 5)


@query()
def zipf_fit(spark, sf_dir):
    return vectors.zipf(_orders(spark, sf_dir), "site").select("site", *[F.round(c, 3).alias(c) for c in ("c", "q", "gamma", "r2")])


FEATURES = ["entropy", "uniqueness", "mean_len", "top_final_share"]


@query(f"""{WITH}, pe AS (SELECT site, -sum(n / t::DOUBLE * log2(n / m::DOUBLE)) AS entropy FROM (SELECT site, n, sum(n) OVER (PARTITION BY site, a) AS m, sum(n) OVER (PARTITION BY site) AS t FROM (SELECT site, a, b, count(*) AS n FROM pairs GROUP BY ALL)) GROUP BY site),
fe AS (SELECT site, count(DISTINCT signs) / count(*)::DOUBLE AS uniqueness, avg(len(signs)) AS mean_len FROM corpus GROUP BY site),
tf AS (SELECT site, max(n) / sum(n)::DOUBLE AS top_final_share FROM (SELECT site, signs[-1] AS s, count(*) AS n FROM corpus GROUP BY ALL) GROUP BY site)
SELECT site, round((entropy - avg(entropy) OVER ()) / coalesce(nullif(stddev_pop(entropy) OVER (), 0), 1), 4) AS entropy, round((uniqueness - avg(uniqueness) OVER ()) / coalesce(nullif(stddev_pop(uniqueness) OVER (), 0), 1), 4) AS uniqueness,
  round((mean_len - avg(mean_len) OVER ()) / coalesce(nullif(stddev_pop(mean_len) OVER (), 0), 1), 4) AS mean_len, round((top_final_share - avg(top_final_share) OVER ()) / coalesce(nullif(stddev_pop(top_final_share) OVER (), 0), 1), 4) AS top_final_share
FROM pe JOIN fe USING (site) JOIN tf USING (site)""")
def site_feature_zscores(spark, sf_dir):
    c = _orders(spark, sf_dir)
    ends = stats.edge_counts(c, True, "site").groupBy("site").agg((F.max("n") / F.sum("n")).alias("top_final_share"))
    f = stats.conditional_entropy(c, "site").select("site", "entropy").join(stats.uniqueness(c, "site").select("site", "uniqueness"), "site").join(stats.summary(c, "site").select("site", "mean_len"), "site").join(ends, "site")
    return vectors.zscore(f, FEATURES).select("site", *[F.round(n, 4).alias(n) for n in FEATURES])


@query()
def civilization_leave_one_out(spark, sf_dir):
    """The corpus and five labelled synthetic ones of as many rows, in eight instances each: each instance's nearest label by the six features, itself left out."""
    c, path = materialize(_orders(spark, sf_dir).select(F.lit("given").alias("label"), F.col("id").cast("string").alias("id"), "signs"), "corpus")
    n = c.count()
    rows = [c, *[nulls.civilization(spark, k, n, 5).select(F.lit(k).alias("label"), "id", "signs") for k in "abcde"]]
    every = reduce(DataFrame.unionByName, rows).withColumn("query", F.concat_ws("-", "label", F.pmod(F.xxhash64("id"), F.lit(8)).cast("string")))
    f = resampling.features(every, "query").withColumn("label", F.split_part("query", F.lit("-"), F.lit(1)))
    discard(spark, path)
    return vectors.nearest_centroid(f, list(resampling.FEATURES), "query", "label").select("query", "actual", "predicted", F.round("distance", 4).alias("distance"))


@query()
def leave_one_out_accuracy(spark, sf_dir):
    """Of the corpus and the synthetic ones, overall (label null) and by label."""
    hit = civilization_leave_one_out(spark, sf_dir).withColumn("hit", (F.col("actual") == F.col("predicted")).cast("double"))
    return hit.rollup(F.col("actual").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("accuracy"))


@query()
def site_features(spark, sf_dir):
    """The six features of each site's corpus."""
    f = resampling.features(_orders(spark, sf_dir), "site")
    return f.select("site", *[F.round(n, 3).alias(n) for n in resampling.FEATURES])


def _labelled(spark):
    r = resampling.features(resampling.references(spark), "key")
    return r.select(F.split_part("key", F.lit("/"), F.lit(1)).alias("label"), *resampling.FEATURES)


def _dependency_sql() -> str:
    """Kneser-Ney gains of the corpus and of nulls of as many rows, each label under its own folds."""
    strata = {"pooled": "'all'", "motif": "motif", "site": "site", "site and motif": "concat_ws('|', site, motif)"}
    drawn = [re.sub(r"\b(sc|ss|so|mg|iv|nk|ns|nn|np|nl)\b", rf"\1_{i}", _drawn(x, "(SELECT count(*) FROM corpus)", 42)) for i, x in enumerate(strata.values())]
    rows = " UNION ALL ".join(f"SELECT '{name}', format('NULL-{{:05d}}', k), signs FROM nl_{i}" for i, name in enumerate(strata))
    c = {1: "", 2: ", c1", 3: ", c1, c2"}
    tables = ", ".join(f"h{o} AS (SELECT label, k, w{x}, sum(n) AS n FROM tr GROUP BY ALL), s{o} AS (SELECT label, k{x}, sum(n) AS t, count(*) AS d FROM h{o} GROUP BY ALL)" for o, x in c.items())
    steps = ", ".join(f"q{o} AS (SELECT q{o - 1}.*, CASE WHEN s{o}.t IS NULL THEN p{o - 1} ELSE greatest(coalesce(h{o}.n, 0) - 0.75, 0) / s{o}.t::DOUBLE + 0.75 * s{o}.d / s{o}.t::DOUBLE * p{o - 1} END AS p{o} FROM q{o - 1} LEFT JOIN h{o} USING (label, k, w{x}) LEFT JOIN s{o} USING (label, k{x}))" for o, x in c.items())
    ppl = " UNION ALL ".join(f"SELECT {o} AS o, label, k, pow(2, -sum(held * log2(greatest(p{o}, 1e-12))) / sum(held)) AS p FROM q3 GROUP BY ALL" for o in c)
    return f"""{WITH}, {', '.join(drawn)}, cp AS (SELECT 'real' AS label, id::VARCHAR AS id, signs FROM corpus UNION ALL {rows}),
fo AS (SELECT label, id, signs, CASE WHEN r < 5 * size THEN r // size ELSE -1 END AS fold FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('0|' || id), id) - 1 AS r, count(*) OVER (PARTITION BY label) // 5 AS size FROM cp)),
x AS (SELECT label, fold, sign AS w, lag(sign, 1, '<S>') OVER q AS c1, lag(sign, 2, '<S>') OVER q AS c2 FROM (SELECT label, id, fold, unnest(signs) AS sign, unnest(range(len(signs))) AS pos FROM fo) WINDOW q AS (PARTITION BY label, id ORDER BY pos)),
y AS (SELECT label, fold, w, c1, c2, count(*) AS n FROM x GROUP BY ALL), ks AS (SELECT unnest(range(5)) AS k), tr AS (SELECT label, k, w, c1, c2, sum(n) AS n FROM y JOIN ks ON fold <> k GROUP BY ALL), {tables},
b AS (SELECT DISTINCT label, k, c1, w FROM tr), bw AS (SELECT label, k, w, count(*) AS kinds FROM b GROUP BY ALL), bk AS (SELECT label, k, count(*) AS kinds FROM b GROUP BY ALL),
q0 AS (SELECT y.label, fold AS k, y.w, c1, c2, n AS held, coalesce(bw.kinds, 0) / bk.kinds::DOUBLE AS p0 FROM y JOIN bk ON bk.label = y.label AND bk.k = fold LEFT JOIN bw ON bw.label = y.label AND bw.k = fold AND bw.w = y.w), {steps},
pp AS ({ppl}), m AS (SELECT o, label, log2(avg(p)) AS h FROM pp GROUP BY ALL), g AS (SELECT label, max(h) FILTER (o = 2) - max(h) FILTER (o = 3) AS gain FROM m GROUP BY 1)
SELECT label, round(gain, 5) AS gain, CASE WHEN label <> 'real' THEN (SELECT round(gain, 5) FROM g WHERE label = 'real') > round(gain, 5) END AS beaten FROM g"""


@query(_dependency_sql())
def stratified_dependency(spark, sf_dir):
    """The third order's gain in the corpus, and in null corpora of as many rows that keep the mix of motifs, sites, or both: whether the corpus beats each."""
    c, path = materialize(_orders(spark, sf_dir).select("id", "signs", "site", "motif"), "corpus")
    n, motif = c.count(), source.broad_motif(F.col("motif"))
    strata = {"pooled": None, "motif": motif, "site": F.col("site"), "site and motif": F.concat_ws("|", F.col("site"), motif)}
    drawn = {name: materialize(nulls.matched_null(c, n, 42, x).select("id", "signs"), "null") for name, x in strata.items()}
    corpora = {"real": c.select("id", "signs")} | {name: x for name, (x, _) in drawn.items()}
    every = reduce(DataFrame.unionByName, [x.select(F.lit(name).alias("label"), F.col("id").cast("string").alias("id"), "signs") for name, x in corpora.items()])
    model = ngram.kneser_ney(folds(every, 5, 0, "label", written=True), 3, (0.75,), "label")
    discard(spark, path, *[x for _, x in drawn.values()])
    gain = ngram.gains(model, "label").where(F.col("order") == 3)
    every = gain.select("label", F.round("gain", 5).alias("gain"))
    real = every.where("label = 'real'").select(F.col("gain").alias("real_"))
    return every.join(F.broadcast(real)).select("label", "gain", F.when(F.col("label") != "real", F.col("real_") > F.col("gain")).alias("beaten"))


@query(f"""{WITH} SELECT count(*)::BIGINT AS n, count(DISTINCT signs)::BIGINT AS n_distinct, round(avg(len(signs)), 6) AS mean_len FROM corpus WHERE site = (SELECT site FROM {_BY_SIZE} ORDER BY n DESC, site LIMIT 1) AND starts_with(motif, 'BUIL')""")
def site_motif_subset(spark, sf_dir):
    """The rows of the largest site whose motif begins in a given way."""
    c = _orders(spark, sf_dir)
    site = c.groupBy("site").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "site").first()["site"]
    rows = source.of_site_and_motif(c, site, "BUIL")
    return rows.agg(F.count("*").alias("n"), F.count_distinct("signs").alias("n_distinct"), F.round(F.avg(F.size("signs")), 6).alias("mean_len"))


@query()
def matched_subset(spark, sf_dir):
    """The label of that subset beside the shares of labels of 30 samples of the whole corpus that are as large."""
    c, path = materialize(_orders(spark, sf_dir).select("id", "signs", "site", "motif"), "corpus")
    site = c.groupBy("site").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "site").first()["site"]
    subset = source.of_site_and_motif(c, site, "BUIL").select(F.lit("subset/0").alias("query"), "id", "signs")
    samples = nulls.subsample(c, subset.count(), 30, 1).select(F.concat_ws("/", F.lit("samples"), F.col("trial").cast("string")).alias("query"), "id", "signs")
    f = resampling.features(subset.unionByName(samples), "query")
    discard(spark, path)
    named = resampling.classify(f, _labelled(spark)).withColumn("corpus", F.split_part("query", F.lit("/"), F.lit(1)))
    return _rounded(resampling.label_shares(named, "corpus"), "share", "error", "low", "high")


@query()
def sample_size_curve(spark, sf_dir):
    """Labels that samples of several sizes are given (30 trials each): share, error and interval."""
    c, path = materialize(_orders(spark, sf_dir).select("id", "signs"), "corpus")
    rows = [nulls.subsample(c, n, 30, n).select(F.concat_ws("/", F.lit(str(n)), F.col("trial").cast("string")).alias("query"), "id", "signs") for n in (100, 500, 1000)]
    f = resampling.features(reduce(DataFrame.unionByName, rows), "query")
    discard(spark, path)
    shares = resampling.label_shares(resampling.classify(f, _labelled(spark)).withColumn("n_rows", F.split_part("query", F.lit("/"), F.lit(1)).cast("int")), "n_rows")
    return _rounded(shares, "share", "error", "low", "high")


@query()
def subsample_interval(spark, sf_dir):
    """The label of 200 samples of 80% of the rows of the site with most, without replacement, with its interval, and whether it is clear."""
    c = _orders(spark, sf_dir)
    site = c.groupBy("site").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "site").first()["site"]
    fanned = nulls.subsample(c.where(F.col("site") == site), trials=200, seed=42, fraction=0.8)
    f = resampling.features(fanned.withColumn("query", F.concat_ws("/", "site", F.col("trial").cast("string"))), "query")
    named = resampling.classify(f, _labelled(spark)).withColumn("site", F.split_part("query", F.lit("/"), F.lit(1)))
    shares = resampling.label_shares(named, "site").withColumn("verdict", resampling.verdict(F.col("share"), 0.85, 0.65, ("clear", "mixed", "unclear")))
    return _rounded(shares, "share", "error", "low", "high")


@query(f"""{_controls_sql()}, x AS (SELECT round(max(entropy) FILTER (label = 'rigid'), 6) AS rigid, round(max(entropy) FILTER (label = 'corpus'), 6) AS corpus, round(max(entropy) FILTER (label = 'random'), 6) AS random FROM en) SELECT *, CASE WHEN rigid < corpus AND corpus < random THEN 'intermediate' ELSE 'outside' END AS verdict FROM x""")
def control_verdict(spark, sf_dir):
    """Whether the corpus' entropy lies between a rigid and a random control."""
    e = entropy_against_controls(spark, sf_dir)
    of = lambda k: F.max(F.when(F.col("label") == k, F.col("entropy"))).alias(k)
    one = e.agg(of("rigid"), of("corpus"), of("random"))
    return one.withColumn("verdict", F.when((F.col("rigid") < F.col("corpus")) & (F.col("corpus") < F.col("random")), "intermediate").otherwise("outside"))


@query(f"""{WITH} SELECT * FROM (VALUES ('rows', CASE WHEN (SELECT count(*) > 0 FROM corpus) THEN 'PASS' ELSE 'FAIL' END, 'the corpus has rows'), ('lengths', CASE WHEN (SELECT min(len(signs)) >= 1 FROM corpus) THEN 'PASS' ELSE 'FAIL' END, 'no row is empty'),
  ('mean length', CASE WHEN (SELECT abs(avg(len(signs)) - 4) <= 0.5 FROM corpus) THEN 'PASS' ELSE 'FAIL' END, 'about four signs'), ('stream', 'SKIPPED', 'no stream here')) AS t(name, status, detail)""")
def check_ledger(spark, sf_dir):
    one = stats.summary(_orders(spark, sf_dir))
    checks = [("rows", F.col("n") > 0, "the corpus has rows"), ("lengths", F.col("min_len") >= 1, "no row is empty"), ("mean length", resampling.within(F.col("mean_len"), 4, 0.5), "about four signs"), ("stream", None, "no stream here")]
    return resampling.ledger(spark, checks, one)


@query()
def demo_corpus_summary(spark, sf_dir):
    """The corpus beside what the generator of the demo corpus makes of as many rows."""
    c, path = materialize(_orders(spark, sf_dir).select("id", "signs"), "corpus")
    demo, demo_path = materialize(nulls.demo_corpus(spark, c.count()), "demo")  # drawn once, read by the filter and both counts
    every = c.select(F.lit("corpus").alias("label"), F.col("id").cast("string").alias("id"), "signs").unionByName(source.keep(demo).select(F.lit("demo").alias("label"), "id", "signs"))
    out, _ = materialize(_rounded(stats.summary(every, "label"), "mean_len"), "summary")
    discard(spark, path, demo_path)
    return out


@query(f"""{WITH}, s AS (SELECT count(*) AS n_signs, count(*) FILTER (f) AS n_beginners, count(*) FILTER (l) AS n_enders, count(*) FILTER (o) AS n_solo FROM (SELECT sign, bool_and(pos = 0) AS f, bool_and(pos = len - 1) AS l, bool_and(len = 1) AS o FROM tok GROUP BY 1))
SELECT n_signs::BIGINT AS n_signs, n_beginners::BIGINT AS n_beginners, n_enders::BIGINT AS n_enders, n_solo::BIGINT AS n_solo, (SELECT count(*) FROM big)::BIGINT AS n_edges,
  (SELECT count(*) FROM big x JOIN big y ON x.a = y.b AND x.b = y.a)::BIGINT AS n_mutual, round((SELECT count(*) FROM big) / (n_signs * n_signs)::DOUBLE, 6) AS connectivity FROM s""")
def network_connectivity(spark, sf_dir):
    return _rounded(stats.network(_orders(spark, sf_dir)), "connectivity")


@query(f"{WITH} SELECT motif, count(*)::BIGINT AS n, count(*) FILTER (len(signs) >= 4)::BIGINT AS n_long FROM full_corpus GROUP BY 1")
def broad_motif_strata(spark, sf_dir):
    c = source.normalized(source.orders_corpus(spark, sf_dir))
    return c.groupBy(source.broad_motif(F.col("motif")).alias("motif")).agg(F.count("*").alias("n"), F.count_if(F.size("signs") >= 4).alias("n_long"))


@query(f"""{WITH}, w AS (SELECT site, count(*)::BIGINT AS n, count(*) FILTER (signs[1] = signs[-1])::BIGINT AS hits FROM corpus GROUP BY 1), v AS (SELECT *, hits / n::DOUBLE AS p FROM w)
SELECT site, n, hits, round(greatest((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 0), 6) AS low, round(least((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 1), 6) AS high FROM v""")
def wilson_interval(spark, sf_dir):
    g = _orders(spark, sf_dir).groupBy("site").agg(F.count("*").alias("n"), F.count_if(F.element_at("signs", 1) == F.element_at("signs", -1)).alias("hits"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return _rounded(g.withColumns({"low": low, "high": high}), "low", "high")


@query("""WITH li AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS t FROM documents), sg AS (SELECT lang, unnest(list_filter(regexp_split_to_array(t, '[\\s\\x0b]+'), lambda x: x <> '')) AS sign FROM li) SELECT lang, sign, count(*)::BIGINT AS n FROM sg GROUP BY 1, 2""")
def line_unigrams(spark, sf_dir):
    """Words of the lines corpus, by language."""
    return stats.unigrams(source.lines_corpus(spark, sf_dir), "motif").withColumnRenamed("motif", "lang")


@query("""SELECT a, b, count(*)::BIGINT AS n FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id, event_type) AS b FROM events) WHERE b IS NOT NULL GROUP BY 1, 2""")
def event_bigrams(spark, sf_dir):
    return stats.bigrams(source.events_corpus(spark, sf_dir))


@query("""SELECT date_trunc('day', ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2""")
def event_windows(spark, sf_dir):
    """The stream's windowed counts, over the whole table at once."""
    from signflow.streaming.counts import windowed_counts

    return windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"))


#: Trials of restoration in SQL: what all other rows say about the sign after the one before.
RESTORED = f"""{WITH}, x AS (SELECT id, pos, sign AS w, lag(sign, 1, '<S>') OVER (PARTITION BY id ORDER BY pos) AS c1 FROM tok), su AS (SELECT id, len(signs) AS len FROM corpus WHERE len(signs) > 1 QUALIFY row_number() OVER (ORDER BY md5('0|11|' || id), id) <= 300),
ask AS (SELECT x.id, x.pos, x.c1, x.w AS truth FROM su JOIN x ON x.id = su.id AND x.pos = floor({_u("'11'", "su.id")} * su.len)), tot AS (SELECT c1, w, count(*) AS n FROM x GROUP BY 1, 2), own AS (SELECT id, c1, w, count(*) AS n FROM x GROUP BY ALL),
gr AS (SELECT ask.id, ask.pos, truth, v.w, coalesce(tot.n, 0) - coalesce(own.n, 0) AS c, (SELECT count(*) FROM uni) AS nv FROM ask CROSS JOIN (SELECT sign AS w FROM uni) v LEFT JOIN tot ON tot.c1 = ask.c1 AND tot.w = v.w LEFT JOIN own ON own.id = ask.id AND own.c1 = ask.c1 AND own.w = v.w),
pr AS (SELECT *, (c + 0.5) / (sum(c) OVER (PARTITION BY id, pos) + 0.5 * nv)::DOUBLE AS p FROM gr), ra AS (SELECT *, row_number() OVER z AS r, coalesce(sum(p) OVER (PARTITION BY id, pos ORDER BY p DESC, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(p) OVER (PARTITION BY id, pos) < 0.9 AS kept FROM pr WINDOW z AS (PARTITION BY id, pos ORDER BY p DESC, w)),
res AS (SELECT id, pos::INT AS pos, truth, max(w) FILTER (r = 1) AS predicted, count(*) FILTER (kept)::BIGINT AS set_size, bool_or(kept AND w = truth) AS in_set FROM ra GROUP BY id, pos, truth)"""


@query(f"{RESTORED} SELECT * FROM res")
def restoration(spark, sf_dir):
    """300 masked signs (a sampling operator): what the other rows predict."""
    c = _orders(spark, sf_dir).select("id", "signs")
    long = c.where(F.size("signs") > 1)
    trials = nulls.subsample(long, 300, 1, 11).withColumn("pos", F.floor(uniform(11, F.col("id")) * F.size("signs")).cast("int"))
    return ngram.restoration(c, trials)


@query(f"{RESTORED} SELECT count(*)::BIGINT AS n, round(avg((predicted = truth)::INT::DOUBLE), 6) AS accuracy, round(avg(in_set::INT::DOUBLE), 6) AS set_accuracy, round(avg(set_size), 6) AS mean_set_size FROM res")
def restoration_summary(spark, sf_dir):
    return _rounded(ngram.restored(restoration(spark, sf_dir)), "accuracy", "set_accuracy", "mean_set_size")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _registry.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _registry.items() if sql}
