"""The library's operators on literals, by invariants, and against SQL on the driver's small tables."""

import hashlib
import itertools
import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from signflow.functions.portable import folds, global_rank, wilson
from signflow.operators import ngram, nulls, stats, substitution, vectors
from signflow.operators.graph import components
from signflow.plans import queries as plans
from signflow.sources import corpus as source

FULL = "id string, signs array<string>, site string, object_type string, motif string"


@pytest.fixture(scope="module")
def tiny(spark):
    rows = [("T1", "A B C", "SiteX", "seal", "MotifA"), ("T2", "A B D", "SiteX", "seal", "MotifA"), ("T3", "A B C", "SiteY", "tablet", "MotifB"), ("T4", "X Y", "SiteY", "tablet", "MotifB"), ("T5", "A B C D", "SiteX", "seal", "MotifA")]
    return spark.createDataFrame([(i, s.split(), *r) for i, s, *r in rows], FULL)


def seqs(spark, *groups):
    return spark.createDataFrame([(f"r{i}", s.split()) for i, s in enumerate(s for n, s in groups for _ in range(n))], "id string, signs array<string>")


def test_summary_and_vocabulary(tiny):
    r = stats.summary(tiny).first()
    assert (r["n"], r["n_signs"], r["n_tokens"], r["min_len"], r["max_len"]) == (5, 6, 15, 2, 4)
    assert tuple(stats.summary(tiny.limit(0)).first()[c] for c in ("n", "n_tokens", "mean_len")) == (0, 0, 0)


def test_bigrams(spark):
    c = seqs(spark, (1, "A B C"), (1, "A B D"))
    assert {(r["a"], r["b"]): r["n"] for r in stats.bigrams(c).collect()} == {("A", "B"): 2, ("B", "C"): 1, ("B", "D"): 1}


def test_csv_round_trip_and_defaults(spark, tiny, tmp_path):
    full = tiny.withColumns({"line_count": F.lit(2), "damaged": F.lit(True), "reading_direction": F.lit("L-R"), "mean_uncertainty": F.lit(1.5), "cisi_number": F.lit("M-1")})
    source.write_csv(full, f"{tmp_path}/c")
    back = source.read_csv(spark, f"{tmp_path}/c")
    assert sorted(map(str, back.select(full.columns).collect())) == sorted(map(str, full.collect()))
    (tmp_path / "m.csv").write_text("inscription_id,sign_sequence\nM1,A B C\n")
    r = source.read_csv(spark, f"{tmp_path}/m.csv").first()
    assert (r["motif"], r["mean_uncertainty"], r["line_count"], r["damaged"], r["signs"]) == ("unknown", 0.0, 1, False, ["A", "B", "C"])
    (tmp_path / "j.json").write_text('[{"inscription_id": "a", "sign_sequence": ["A", "B"]}, {"inscription_id": "b", "sign_sequence": "C D"}]')
    assert {r["id"]: r["signs"] for r in source.read_json(spark, f"{tmp_path}/j.json").collect()} == {"a": ["A", "B"], "b": ["C", "D"]}


def test_g2_ranks_the_strong_pair_first(spark):
    c = seqs(spark, (20, "A B"), (2, "C A"), (2, "B C"))
    assert tuple(stats.g2(c, 1).orderBy(F.desc("g2")).first()[:2]) == ("A", "B")


def test_kneser_ney_uses_the_longer_context(spark):
    c = seqs(spark, (30, "X B C"), (30, "Y B C"), (5, "Z D W"))
    df = ngram.kneser_ney(folds(c, 5), 3)
    by = {r["order"]: r["perplexity"] for r in ngram.gains(df).collect()}
    assert by[3] < by[1] and all(p >= 1 for p in by.values())


def test_folds_leave_the_remainder_out(spark):
    c = seqs(spark, (23, "A B"))
    assert Counter(r["fold"] for r in folds(c, 5).collect()) == {**dict.fromkeys(range(5), 4), -1: 3}
    assert sorted(r["rank"] for r in global_rank(c, "id").collect()) == list(range(23))


def test_minimal_pairs_and_graph(tiny):
    p = substitution.minimal_pairs(tiny, None)
    assert sorted((r["id_a"], r["id_b"], r["position"], r["context"], r["same_motif"]) for r in p.collect()) == [("T1", "T2", 2, True, True), ("T2", "T3", 2, False, False)]
    e = substitution.edges(p)
    assert [(r["u"], r["v"], r["weight"], r["positions"]) for r in e.collect()] == [("C", "D", 2, [2])]
    assert {r["component"] for r in substitution.classes(e).collect()} == {"C"}


def test_components_of_a_long_chain(spark):
    df = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    for small in (0, 1000):
        assert {r["component"] for r in components(df, small=small).collect()} == {0}
        assert components(df.limit(0), small=small - 1).count() == 0


def test_modularity_splits_a_barbell(spark):
    e = [(a, b) for g in ("abcd", "wxyz") for a in g for b in g if a < b] + [("d", "w")]
    got = {r["sign"]: r["community"] for r in substitution.modularity_classes(spark.createDataFrame([(*x, 1) for x in e], "u string, v string, weight int")).collect()}
    assert got == {**dict.fromkeys("abcd", "a"), **dict.fromkeys("wxyz", "w")}


def test_classes_keep_parts_apart_and_stability_measures_each(spark):
    rows = [(f"{t}{i}", t, [x, "M", "N"]) for t, signs in (("p", "ABC"), ("q", "AB"), ("r", "C")) for i, x in enumerate(signs)]
    c = spark.createDataFrame(rows, "id string, site string, signs array<string>").withColumns({"object_type": F.lit("o"), "motif": F.lit("m")})
    whole = spark.createDataFrame([(x, "A") for x in "ABC"], "sign string, component string")
    got = {r["site"]: (r["members"], r["jaccard"]) for r in substitution.stability_by_part(c, whole, "site").collect()}
    assert got == {"p": (3, 1.0), "q": (2, 1.0)}  # one member is no class
    got = {r["component"]: r for r in substitution.class_positions(substitution.minimal_pairs(c), whole, stats.slot_counts(c)).collect()}["A"]
    assert (got["members"], got["mean_initial"], got["std_initial"], got["mean_final"], got["n_pairs"], got["top_position"], got["top_share"], got["slot_like"]) == (3, 1.0, 0.0, 0.0, 12, 0, 1.0, True)  # 15 pairs of rows, 3 of equal ones


def test_shuffles_keep_what_they_should(spark):
    c = seqs(spark, (9, "A B C D E"), (4, "F G"), (2, "H"))
    own = {r["id"]: r["signs"] for r in c.collect()}
    within = {r["id"]: r["signs"] for r in nulls.within_shuffle(c, 1).collect()}
    ends = {r["id"]: r["signs"] for r in nulls.position_preserving_shuffle(c, 1).collect()}
    total = {r["id"]: r["signs"] for r in nulls.global_shuffle(c, 1).collect()}
    assert all(sorted(within[k]) == sorted(v) for k, v in own.items())
    assert all((ends[k][0], ends[k][-1], sorted(ends[k])) == (v[0], v[-1], sorted(v)) for k, v in own.items())
    assert all(len(total[k]) == len(v) for k, v in own.items()) and Counter(sum(total.values(), [])) == Counter(sum(own.values(), []))


def test_null_models_stay_in_the_vocabulary(spark):
    c = seqs(spark, (50, "A B A B C")).withColumn("motif", F.when(F.col("id") < "r3", "m").otherwise("n"))
    for df in (nulls.matched_null(c, 200), nulls.matched_null(c, 200, 1, F.col("motif")), nulls.markov_null(c, 200), nulls.markov_null(c, 200, 2)):
        rows = [r["signs"] for r in df.collect()]
        assert len(rows) == 200 and all(r and set(r) <= set("ABC") for r in rows)
    assert {tuple(r["signs"]) for r in nulls.matched_null(c, 50).where("signs[0] <> 'A'").collect()} == set()
    assert nulls.markov_null(c.limit(0), 5).count() == 0 == nulls.markov_null(c.limit(0), 5, 2).count()


def test_markov_chains_of_any_table_size_and_their_start(spark, monkeypatch):
    c = seqs(spark, (30, "A B"), (20, "A B C"), (10, "C"), (5, "B A A"))
    few = [sorted(map(tuple, nulls.markov_null(c, 300, k, 5).collect())) for k in (1, 2)]
    monkeypatch.setattr(nulls, "SMALL", 0)
    assert [sorted(map(tuple, nulls.markov_null(c, 300, k, 5).collect())) for k in (1, 2)] == few
    two = [r for _, r in few[1]]
    assert set(map(tuple, two)) <= {("A", "B"), ("A", "B", "C"), ("C",), ("B",), ("A",), ("B", "A", "A"), ("B", "C")} | {t for t in map(tuple, two) if len(t) == 1 or t[0] in "AB"}
    assert 0.02 < np.mean([len(t) == 1 for t in two]) < 0.12  # a tenth begins with one sign
    assert max(len(r) for _, r in map(tuple, nulls.markov_null(seqs(spark, (3, "A A A A A A")), 20, 1, 1, 7).collect())) == 7


def test_whole_corpus_trials_draw_what_the_null_draws(spark, monkeypatch):
    c = seqs(spark, (30, "A B"), (20, "A B C"), (10, "C"), (5, "B A A"))
    want = {}
    for r in nulls.matched_null(c, 65, 3, trials=4).collect():
        want.setdefault(r["trial"], []).append(tuple(r["signs"]))
    for most in (nulls.SMALL, 0):
        got = {r["trial"]: (r["n_distinct"], r["n"]) for r in nulls.matched_null_uniqueness(c, 4, seed=3, most=most).collect()}
        assert got == {t: (len(set(x)), 65) for t, x in want.items()}
    assert nulls.matched_null_uniqueness(c.limit(0), 4).count() == 0


def test_one_mining_gives_the_pairs_of_all_trials(spark):
    from signflow.operators import resampling

    rng = np.random.default_rng(2)
    rows = [(f"r{i}", list(rng.choice(list("ABCD"), rng.integers(1, 4))), str(rng.choice(["s", "t", "unknown"])), "o", "m") for i in range(300)]
    c = spark.createDataFrame(rows, FULL)
    with_bits = resampling.with_trials(c, 40, 70, 6)
    samples = nulls.subsample(c, 40, 70, 6)
    bits = {(r["id"], t) for r in with_bits.collect() for t in range(70) if (r["trials"][t // 64] >> t % 64) & 1}
    assert bits == {(r["id"], r["trial"]) for r in samples.collect()} and len(bits) == 70 * 40
    want = {(r["trial"], r["sign_a"], r["sign_b"]) for r in substitution.pair_counts(samples, "context", "trial").collect()}
    assert {(r["trial"], r["u"], r["v"]) for r in substitution.pair_trials(with_bits, 70, "context").collect()} == want
    whole = spark.createDataFrame([(x, "A") for x in "ABC"] + [("D", "D")], "sign string, component string")
    one = substitution.stability_by_trial(with_bits, whole, 70, "context").collect()
    assert sorted(map(str, one)) == sorted(str(r) for r in substitution.stability_by_part(samples, whole, "trial", "context").select(one[0].__fields__).collect())
    call = substitution.matched_size(spark.createDataFrame([("A", 3, 0.5), ("Z", 2, 0.1)], "class string, members bigint, jaccard double"), spark.createDataFrame([("A", 0.4, 0), ("A", 0.6, 1)], "class string, jaccard double, trial int"))
    assert {r["class"]: (r["low"], r["high"], r["explained"], r["vacuous"]) for r in call.collect()} == {"A": (0.4, 0.6, True, False), "Z": (None, None, None, None)}
    assert {(r["id"], r["trial"]) for r in nulls.subsample(c, 1000, 2, 1).collect()} == {(r[0], t) for r in rows for t in (0, 1)}
    half = nulls.subsample(c, fraction=0.25, trials=3, seed=2, keys=("site",)).groupBy("site", "trial").count().collect()
    sizes = Counter(r[2] for r in rows)
    assert {(r["site"], r["trial"]): r["count"] for r in half} == {(s, t): max(1, round(0.25 * n)) for s, n in sizes.items() for t in range(3)}


def test_direction_of_a_planted_corpus(spark):
    rows = [(f"r{i}", [f"I{i % 20}", f"M{i % 3}", "END"]) for i in range(200)]
    c = spark.createDataFrame(rows, "id string, signs array<string>")
    assert stats.direction(c).first()["likely"] == "as-stored"
    assert stats.direction(c.withColumn("signs", F.reverse("signs"))).first()["likely"] == "reversed"


def test_wilson_and_zipf(spark):
    low, high = wilson(F.lit(200), F.lit(200))
    r = spark.range(1).select(low, high).first()
    assert math.isclose(r[0], 0.981, abs_tol=1e-3) and r[1] == 1
    c, q, g, r2 = vectors.fit_zipf([(k, 100 / (k + 2) ** 1.1) for k in range(1, 60)])
    assert abs(q - 2) < 0.05 and abs(g - 1.1) < 0.02 and r2 > 0.9999


def test_restoration_leaves_the_own_row_out(spark):
    c = seqs(spark, (6, "A B"), (1, "A C"))
    r = ngram.restoration(c, spark.createDataFrame([("r6", 1)], "id string, pos int")).first()
    assert (r["truth"], r["predicted"]) == ("C", "B")


@pytest.mark.parametrize("name", ["conditional_entropy_by_site", "llr_bigrams", "kn_cv_ppl", "minimal_pairs_by_position", "components", "class_positions", "global_shuffle"])
def test_queries_equal_sql(spark, name):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("customer", "nation", "part", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = plans.queries()[name](spark, sf)
    want = con.execute(plans.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(str, df.select(columns).toPandas().itertuples(index=False, name=None))) == sorted(map(str, want.df().itertuples(index=False, name=None)))


def test_pair_counts_are_of_all_pairs(spark):
    rows = [(f"r{i:03}", ["AB"[i >= 450], "M", "N"], f"s{i % 2}", "o", "m") for i in range(900)]
    c = spark.createDataFrame(rows, FULL)
    got = {t: [tuple(r) for r in substitution.pair_counts(c, t).collect()] for t in ("all", "context", "motif")}
    assert got == {"all": [(3, 0, "A", "B", 450 * 450)], "context": [(3, 0, "A", "B", 2 * 225 * 225)], "motif": [(3, 0, "A", "B", 2 * 225 * 225)]}
    # Rows of the two signs that are far apart by id: runs of 400 would leave the parts without a class
    far = spark.createDataFrame([(f"r{i:03}", ["ABC"[(i > 0) + (i == 899)], "M", "N"], "s", "o", "m") for i in range(900)], FULL)
    found = substitution.stability_by_part(far, spark.createDataFrame([(x, "A") for x in "ABC"], "sign string, component string"), "site").first()
    assert (found["members"], found["jaccard"]) == (3, 1.0)
    assert substitution.edges(substitution.pair_counts(far)).count() == 3


WHOLE = [n for n in plans.queries() if n.endswith("_whole")]


@pytest.mark.parametrize("name", WHOLE)
def test_whole_queries_equal_sql_without_runs(spark, name):
    sf, con = "/root/testdata/sf0.01", duckdb.connect()  # lengths of far more than 400 rows
    for t in ("customer", "nation", "part", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = plans.queries()[name](spark, sf)
    want = con.execute(plans.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    rows = lambda x: sorted(map(str, x.itertuples(index=False, name=None)))
    assert rows(df.select(columns).toPandas()) == rows(want.df()[columns])


def test_whole_queries_have_sql_of_their_own():
    assert len(WHOLE) == 7 and not any("// 400" in plans.oracle_sql()[n] for n in WHOLE)


def test_neighbours_of_many_queries(spark, monkeypatch):
    e = spark.range(10_001).select(F.col("id").alias("k"), F.array(F.lit(1.0), F.col("id") / 10_000).alias("v"))
    base = spark.createDataFrame([(-1, [1.0, 0.0]), (-2, [0.0, 1.0]), (-3, [1.0, 1.0]), (5, [1.0, 0.0])], "k bigint, v array<double>")
    want = sorted(tuple(r) for r in vectors.cosine_neighbours(e.where("k < 500"), base, "k", "v", 2).collect())
    got = vectors.cosine_neighbours(e, base, "k", "v", 2).cache()
    assert got.count() == 2 * 10_001 and sorted(tuple(r) for r in got.where("query < 500").collect()) == want
    monkeypatch.setattr(vectors, "BLOCK", 100)
    monkeypatch.setattr(vectors, "SHARD", 1)
    assert sorted(tuple(r) for r in vectors.cosine_neighbours(e.where("k < 500"), base, "k", "v", 2).collect()) == want


def test_neighbours_are_found_by_blocks_with_the_order_of_the_formula(spark):
    """Nulls, zeros, not-a-numbers, other lengths and many copies, against the formula on every pair; no row is made for a pair."""
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(60)] + [(100 + i, [1.0, 2.0, 3.0]) for i in range(20)]
    rows += [(200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, None, 2.0]), (203, [1.0, 2.0]), (204, [float("nan"), 1.0, 1.0]), (205, [-1.0, -2.0, -3.0])]
    e = spark.createDataFrame(rows, "k bigint, v array<double>")
    every = e.select(F.col("k").alias("query"), F.col("v").alias("w")).join(e, F.col("k") != F.col("query")).select("query", "k", F.round(vectors.cosine(F.col("v"), F.col("w")), 6).alias("s"))
    for k in (5, 80):
        want = {}
        for r in every.orderBy("query", F.desc("s"), "k").collect():
            want.setdefault(r["query"], []).append((r["k"], str(r["s"])))
        got = {}
        for r in vectors.cosine_neighbours(e, e, "k", "v", k).orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append((r["k"], str(r["similarity"])))
        assert got == {q: x[:k] for q, x in want.items()}
    names = e.where("k < 60").select(F.concat(F.lit("s"), F.col("k").cast("string")).alias("k"), "v")
    plan = vectors.cosine_neighbours(names, names, "k", "v", 2)
    assert plan.count() == 120 and "FlatMapCoGroupsInArrow" in plan._jdf.queryExecution().toString()


def test_components_with_hot_nodes(spark, monkeypatch):
    from signflow.functions import skew
    from signflow.operators.graph import components

    monkeypatch.setattr(skew, "LEAST", 5)
    pairs = [(1, i) for i in range(2, 60)] + [(i, i + 1) for i in range(100, 160)] + [(200, 200), (300, 301), (301, 300)]
    edges = spark.createDataFrame(pairs, "a bigint, b bigint")
    want = {i: 1 for i in range(1, 60)} | {i: 100 for i in range(100, 161)} | {300: 300, 301: 300}
    for nodes, small in ((1000, 0), (0, 0), (0, 1000)):
        assert {r["node"]: r["component"] for r in components(edges, broadcast_nodes=nodes, small=small).collect()} == want
        assert components(edges.limit(0), broadcast_nodes=nodes, small=small).count() == 0


def test_join_hot(spark, monkeypatch):
    from signflow.functions import skew

    monkeypatch.setattr(skew, "LEAST", 3)
    rows = spark.createDataFrame([(k, i) for k, m in (("a", 20), ("b", 2), ("c", 1)) for i in range(m)], "k string, i int")
    table = spark.createDataFrame([("a", 20, 1.0), ("b", 2, 2.0), ("d", 9, 3.0)], "k string, n bigint, x double")
    assert skew.join_hot(rows, table, ["k"], "n", 23).count() == 22
    left = skew.join_hot(rows, table, ["k"], "n", 23, "left")
    assert left.count() == 23 and left.columns == ["k", "i", "x"] and left.where("x is null").count() == 1


def _corpus(spark, rows):
    return spark.createDataFrame([(f"T{i:03}", x.split(), f"Site{i % 2}", "seal", "M") for i, x in enumerate(rows)], "id string, signs array<string>, site string, object_type string, motif string")


def test_draws_follow_their_table(spark):
    from signflow.functions.portable import uniform
    from signflow.operators import nulls

    counts = spark.createDataFrame([("x", "A", 900), ("x", "B", 100), ("y", "C", 1), *[("z", f"w{i}", 1 + 5000 * (i == 3)) for i in range(300)]], "source string, sign string, n bigint")
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 4 == 0, "z").when(F.col("id") % 4 == 3, "none").otherwise("x").alias("source"), uniform("d", F.col("id")).alias("u"))
    got = nulls.draw(rows, "u", nulls.intervals(counts, "source"), ["source"], "sign").collect()
    assert len(got) == 3000 and all((r["sign"] is None) == (r["source"] == "none") for r in got)
    x = [r["sign"] for r in got if r["source"] == "x"]
    assert 0.86 < x.count("A") / len(x) < 0.94
    z = [r["sign"] for r in got if r["source"] == "z"]
    assert 0.9 < z.count("w3") / len(z) < 0.98 and len(set(z)) > 10


def test_trials_and_shares(spark):
    from signflow.operators import resampling

    t = spark.createDataFrame([(i, float(i)) for i in range(10)], "trial int, x double")
    r = resampling.over_trials(t, "x", 7.0).first()
    assert (r["n"], r["mean"], r["low"], r["high"], r["p_value"]) == (10, 4.5, 0.0, 9.0, 0.3) and abs(r["sd"] - 2.8722813) < 1e-6
    shares = {r["predicted"]: r for r in resampling.label_shares(spark.createDataFrame([("a",)] * 3 + [("b",)], "predicted string")).collect()}
    assert shares["a"]["share"] == 0.75 and abs(shares["a"]["error"] - 0.2165064) < 1e-6 and 0.3 < shares["a"]["low"] < 0.31
    v = spark.createDataFrame([(0.9,), (0.7,), (0.1,), (None,)], "x double").select(resampling.verdict(F.col("x"), 0.85, 0.65, ("hi", "mid", "lo")).alias("v")).collect()
    assert [r["v"] for r in v] == ["hi", "mid", "lo", None]
    f = spark.createDataFrame([("real", 2.0), ("real", 4.0), ("null", 6.0)], "label string, x double")
    d = resampling.differences(f, "label", "real", ["x"]).first()
    assert (d["mean"], d["real_mean"]) == (6.0, 3.0) and abs(d["pct_diff"] - 100) < 1e-4
    one = spark.createDataFrame([(5,)], "n int")
    got = resampling.ledger(spark, [("a", F.col("n") == 5, ""), ("b", F.col("n") == 6, ""), ("c", None, ""), ("d", resampling.within(F.col("n"), 5.2, 0.3), "")], one).collect()
    assert [r["status"] for r in got] == ["PASS", "FAIL", "SKIPPED", "PASS"]


def test_nearest_reference(spark):
    from signflow.operators import resampling

    labelled = spark.createDataFrame([("a", 0.0, 1.0), ("a", 0.2, 1.0), ("b", 5.0, 1.0), ("b", 5.4, 1.0)], "label string, x double, y double")
    queries = spark.createDataFrame([("q", 0.5, 1.0), ("r", 4.0, 1.0)], "query string, x double, y double")
    got = {r["query"]: r for r in resampling.classify(queries, labelled, ("x", "y")).collect()}
    assert got["q"]["predicted"] == "a" and got["r"]["predicted"] == "b"
    x = np.array([0.0, 0.2, 5.0, 5.4, 0.5])
    assert abs(got["q"]["distance"] - 0.4 / x.std()) < 1e-9


def test_perplexity_ratio_matches_a_loop(spark):
    import hashlib

    from signflow.operators import ngram

    rng = np.random.default_rng(2)
    rows = [(f"i{i}", " ".join(rng.choice(list("ABCD"), rng.integers(1, 6))).split(), f"s{i % 3}") for i in range(40)]
    got = {r["site"]: r["ratio"] for r in ngram.perplexity_ratio(spark.createDataFrame(rows, "id string, signs array<string>, site string"), "site").collect()}
    for site in ("s0", "s1", "s2"):
        own = sorted((r for r in rows if r[2] == site), key=lambda r: (hashlib.md5(f"0|{r[0]}".encode()).hexdigest(), r[0]))
        v, size = len({w for r in own for w in r[1]}) + 1, max(1, len(own) // 3)
        means = []
        for order in (1, 2):
            each = []
            for k in range(3):
                held, train = own[k * size : (k + 1) * size], own[: k * size] + own[(k + 1) * size :]
                grams = lambda part: [((("<S>", *r[1])[j],) if order == 2 else (), w) for r in part for j, w in enumerate(r[1])]  # noqa: E731, B023
                seen = grams(train)
                p = [(seen.count(g) + 0.5) / (sum(c == g[0] for c, _ in seen) + 0.5 * v) for g in grams(held)]
                each.append(2 ** -np.mean(np.log2(p)))
            means.append(np.mean(each))
        assert abs(got[site] - means[1] / means[0]) < 1e-9


def test_class_similarity_equals_its_pairs(spark):
    from signflow.operators import substitution

    rng = np.random.default_rng(3)
    v = {f"s{i}": rng.standard_normal(5) for i in range(12)}
    v["s11"] = np.zeros(5)
    members = spark.createDataFrame([("a", f"s{i}") for i in range(5)] + [("b", "s10"), ("b", "s11"), ("c", "s7")], "component string, sign string")
    vectors = spark.createDataFrame([(k, x.tolist()) for k, x in v.items()], "sign string, vector array<double>")
    got = {r["component"]: r for r in substitution.mean_similarity(members, vectors, "component").collect()}
    cos = [v[f"s{i}"] @ v[f"s{j}"] / np.linalg.norm(v[f"s{i}"]) / np.linalg.norm(v[f"s{j}"]) for i in range(5) for j in range(i)]
    assert abs(got["a"]["similarity"] - np.mean(cos)) < 1e-9 and abs(got["b"]["similarity"]) < 1e-9 and got["c"]["similarity"] is None
    found = {r["component"]: r for r in substitution.corroborated(members, vectors, 20, 1).collect()}
    assert set(found) == {"a", "b"} and all(r["corroborated"] == (r["similarity"] > r["baseline"] + 1e-9) for r in found.values())
    cosine = lambda x, y: 0.0 if not (v[x].any() and v[y].any()) else v[x] @ v[y] / np.linalg.norm(v[x]) / np.linalg.norm(v[y])
    for name, k in (("a", 5), ("b", 2)):
        sets = [sorted(v, key=lambda s: hashlib.md5(f"1|{d}|{s}".encode()).hexdigest())[:k] for d in range(20)]
        assert all(len(set(x)) == k for x in sets)  # without replacement
        assert abs(found[name]["baseline"] - np.mean([np.mean([cosine(x, y) for x, y in itertools.combinations(one, 2)]) for one in sets])) < 1e-9


def test_sparse_svd_is_the_dense_one(spark):
    rng = np.random.default_rng(4)
    m = np.zeros((70, 70))
    for g in range(7):  # seven groups of unlike strength, and noise
        m[np.ix_(range(10 * g, 10 * g + 10), range(10 * g, 10 * g + 10))] = rng.random((10, 10)) * (g + 1)
    m = np.where(rng.random(m.shape) < 0.1, m + 0.3, m)
    m[69] = 0
    names = [f"s{i:02}" for i in range(70)]
    cells = [(names[i], names[j], float(x)) for (i, j), x in np.ndenumerate(m) if x or i == 69 and j == 0]
    u, e, _ = np.linalg.svd(m)
    for dims, more in ((5, 6), (20, 60)):
        got = {r["sign"]: np.array(r["vector"]) for r in vectors.embed(spark.createDataFrame(cells, "a string, b string, ppmi double"), dims, more).collect()}
        have, want = np.array([got[n] for n in names]), u[:, :dims] * e[:dims]
        assert have.shape == want.shape and not have[69].any()
        cos = lambda x: (x @ x.T) / np.maximum(np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)), 1e-9)
        assert np.abs(cos(have)[:69, :69] - cos(want)[:69, :69]).max() < 1e-4
    assert vectors.embed(spark.createDataFrame([], "a string, b string, ppmi double")).count() == 0
    assert {tuple(r["vector"]) for r in vectors.embed(spark.createDataFrame([("a", "b", 0.0), ("b", "a", 0.0)], "a string, b string, ppmi double"), 3).collect()} == {(0.0,)}


def test_restoration_scores_all_signs(spark):
    rng = np.random.default_rng(6)
    rows = [list(map(str, rng.choice(list("ABCDEFGHIJ"), rng.integers(2, 5), p=np.array([30, 20, 10, 5, 3, 2, 1, 1, 1, 1]) / 74))) for _ in range(60)] + [["Z", "Y"], ["X", "Z"]]
    c = spark.createDataFrame([(f"r{i}", s) for i, s in enumerate(rows)], "id string, signs array<string>")
    asked = [(f"r{i}", p) for i, s in enumerate(rows) for p in range(len(s))]
    got = {(r["id"], r["pos"]): r for r in ngram.restoration(c, spark.createDataFrame(asked, "id string, pos int")).collect()}
    vocab = sorted({x for s in rows for x in s})
    for i, s in enumerate(rows):
        for p, truth in enumerate(s):
            before = s[p - 1] if p else "<S>"
            counts = Counter(t[q] for j, t in enumerate(rows) if j != i for q in range(len(t)) if (t[q - 1] if q else "<S>") == before)
            total, line = sum(counts.values()) + 0.5 * len(vocab), sorted(vocab, key=lambda x: (-counts[x], x))
            inside = [x for k, x in enumerate(line) if sum(counts[y] + 0.5 for y in line[:k]) / total < 0.9]
            r = got[f"r{i}", p]
            assert (r["truth"], r["predicted"], r["set_size"], r["in_set"]) == (truth, line[0], len(inside), truth in inside)


def test_summaries_name_the_first_pairs(spark):
    from signflow.operators import substitution

    c = _corpus(spark, ["A B C", "X Y", "A B D", "X Z", "A B E", "X Y"])
    c = c.withColumn("site", F.lit("S"))
    pairs = substitution.minimal_pairs(c, None)
    got = {r["component"]: r for r in substitution.summaries(pairs, substitution.classes(substitution.edges(pairs)), 2).collect()}
    assert got["C"]["signs"] == ["C", "D", "E"] and got["C"]["examples"] == ["C>D", "C>E"] and got["Y"]["size"] == 2 and got["Y"]["examples"] == ["Y>Z", "Z>Y"]


def test_generators_keep_their_habits(spark):
    from signflow.operators import nulls

    c = nulls.demo_corpus(spark, 1500).collect()
    long = [r["signs"] for r in c if len(r["signs"]) > 1]
    assert len(c) == 1500 and min(len(r["signs"]) for r in c) >= 1 and max(len(r["signs"]) for r in c) <= 26
    assert 0.4 < np.mean([s[-1] == "S001" for s in long]) < 0.6 and 0.5 < np.mean([r["signs"][0] in ("S003", "S004", "S005") for r in c]) < 0.7
    ends = [s for s in long if s[-1] == "S001"]
    assert 0.25 < np.mean([len(s) > 2 and s[-2] == "S001" for s in ends]) < 0.5  # the common last sign is itself doubled
    assert 0.05 < np.mean([r["damaged"] for r in c]) < 0.11 and len({r["site"] for r in c}) == 5
    assert c == nulls.demo_corpus(spark, 1500).collect()
    d = nulls.civilization(spark, "d", 800, 1).collect()
    assert all(1 <= len(r["signs"]) <= 14 for r in d) and len({x for r in d for x in r["signs"]}) <= 40
    for kind in "abce":
        assert nulls.civilization(spark, kind, 50, 1).where(F.size("signs") > 0).count() == 50


def test_controls_and_streams(spark, tmp_path):
    from signflow.operators import nulls
    from signflow.sources import corpus

    rows = nulls.rigid_control(spark, 30, 200, 4.2, 5, 1).collect()
    assert len({tuple(r["signs"]) for r in rows}) <= 5 and {len(r["signs"]) for r in rows} == {4}
    corpus.write_report(spark.createDataFrame([("a", 1, [1.5])], "k string, n int, x array<double>"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().asDict() == {"k": "a", "n": 1, "x": [1.5]}


SQL_QUERIES = ["component_corroboration", "cross_site_corroboration", "control_verdict", "kn_gain_by_discount", "bigram_markov_null", "trigram_markov_null", "component_stability_subsampled", "component_stability_by_site", "matched_size_call", "matched_null", "stratified_null", "uniqueness_against_null_trials", "feature_differences", "entropy_curve", "discount_sweep", "perplexity_ratio_by_site", "class_summaries", "pair_report", "restoration_summary", "check_ledger", "subsample", "minimal_pairs_by_position"]


@pytest.mark.parametrize("name", SQL_QUERIES)
def test_more_queries_equal_sql(spark, name):
    from collections import Counter

    import duckdb

    from signflow.plans import queries

    con = duckdb.connect()
    for t in ("lineitem", "part", "orders", "customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    found = con.execute(queries.oracle_sql()[name])
    order = [d[0] for d in found.description]
    columns = sorted(order)
    want = Counter(tuple(str(r[order.index(c)]) for c in columns) for r in found.fetchall())
    df = queries.queries()[name](spark, "/root/testdata/sf0.001")
    assert sorted(df.columns) == columns and Counter(tuple(str(r[c]) for c in columns) for r in df.collect()) == want


def test_choices_by_bucket_and_one_draw_of_the_length(spark):
    edges = (np.cumsum(1 / (np.arange(1, 121) + 2.7) ** 1.15) / np.sum(1 / (np.arange(1, 121) + 2.7) ** 1.15)).tolist()
    asked = [0.0, *edges, *(np.arange(0, 2**32, 2**22) / 2**32).tolist(), 1 - 2.0**-32]
    got = spark.createDataFrame([(x,) for x in asked], "u double").select("u", nulls.chosen(edges, F.col("u")).alias("i")).collect()
    assert [r["i"] for r in got] == [min(int(np.searchsorted(edges, r["u"], "right")), 119) for r in got]
    plan = nulls.demo_corpus(spark, 10).select("signs")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("COS(") == 1  # the length is a column, not drawn anew for each sign


def _odd_corpus(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, [f"s{x}" for x in rng.integers(0, 5, rng.integers(1, 5))], f"S{rng.integers(2)}", "T", "M" if rng.random() < 0.9 else "unknown") for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, signs array<string>, site string, object_type string, motif string")


def test_first_pairs_are_those_of_all_pairs(spark):
    c = _odd_corpus(spark, 300)
    members = substitution.classes(substitution.edges(substitution.pair_counts(c, "motif")))
    every = substitution.tier(substitution.minimal_pairs(c, None), "motif")
    few = substitution.first_pairs(c, "motif")
    told = lambda pairs: sorted((r["component"], r["size"], tuple(r["examples"])) for r in substitution.summaries(pairs, members).collect())
    assert told(few) == told(every) and few.count() < every.count()


def test_equal_rows_are_counted_before_their_places(spark):
    c = _odd_corpus(spark, 400, 1)
    for name, keys in (("all", ()), ("motif", ("site",))):
        pairs = substitution.tier(substitution.minimal_pairs(c, None, *keys), name)
        want = pairs.groupBy(*keys, "len", "position", F.least("sign_a", "sign_b"), F.greatest("sign_a", "sign_b")).count()
        assert sorted(map(tuple, substitution.pair_counts(c, name, *keys).collect())) == sorted(map(tuple, want.collect()))
    tagged = substitution.in_runs(c, 20)
    want = substitution.minimal_pairs(c, 20).groupBy("len", "position", F.least("sign_a", "sign_b"), F.greatest("sign_a", "sign_b")).count()
    assert sorted(map(tuple, substitution.pair_counts(tagged, within=("chunk",)).collect())) == sorted(map(tuple, want.collect()))
    copies = c.crossJoin(spark.range(50).select(F.col("id").alias("copy")))
    plan = substitution.pair_counts(copies)
    plan.collect()
    assert "ReusedExchange" in plan._jdf.queryExecution().executedPlan().toString()  # the places travel once, after their rows are counted


@pytest.mark.parametrize("n, widths", [(7, 8.0), (150, 0.01), (298, 8.0), (500, 8.0)])
def test_cuts_are_exact_and_trials_hold_sampled_rows_only(spark, n, widths):
    from signflow.operators import resampling

    c = spark.range(300).select("id", F.array(F.lit("A")).alias("signs"))
    got = {r["trial"]: r["cut"] for r in nulls.cuts(c, 70, 4, n, widths=widths).collect()}
    hashes = {t: sorted(hashlib.md5(f"{t}|4|{i}".encode()).hexdigest() for i in range(300)) for t in range(70)}
    assert got == {t: x[min(n, 300) - 1] for t, x in hashes.items()}
    rows = resampling.with_trials(c, n, 70, 4).collect()
    want = {i: sum(1 << t for t in range(70) if hashlib.md5(f"{t}|4|{i}".encode()).hexdigest() <= got[t]) for i in range(300)}
    assert {r["id"]: sum((w % 2**64) << 64 * k for k, w in enumerate(r["trials"])) for r in rows} == {i: x for i, x in want.items() if x}
    by_key = nulls.cuts(c.withColumn("part", F.col("id") % 3), 2, 1, fraction=0.5, keys=("part",)).collect()
    assert {(r["part"], r["trial"]): r["cut"] for r in by_key} == {(p, t): sorted(hashlib.md5(f"{t}|1|{i}".encode()).hexdigest() for i in range(p, 300, 3))[49] for p in range(3) for t in range(2)}
    assert nulls.cuts(c.limit(0), 2, 1, 5).count() == 0


def test_hashed_numbers_of_whole_arrays():
    from signflow.functions.portable import uniform_of

    k = np.array([0, 1, 9, 10, 99, 100, 12345, 10**9, 10**18])
    for before, after in (("5|sign|", "|3"), ("5|length|", ""), ("x" * 20, "|12")):
        assert uniform_of(before, k, after).tolist() == [int(hashlib.md5(f"{before}{i}{after}".encode()).hexdigest()[:8], 16) / 2**32 for i in k.tolist()]


def test_trials_in_parts_marked_or_sorted_draw_what_the_null_draws(spark, monkeypatch):
    rng = np.random.default_rng(1)
    for vocab, longest, n in ((2, 3, 900), (25, 7, 2000), (300, 12, 1000), (1, 90, 300)):
        c = spark.createDataFrame([(f"r{i}", [f"s{int(x)}" for x in rng.random(rng.integers(1, longest + 1)) ** 2 * vocab]) for i in range(200)], "id string, signs array<string>")
        want = {}
        for r in nulls.matched_null(c, n, 3, trials=2).collect():
            want.setdefault(r["trial"], set()).add(tuple(r["signs"]))
        for marks, together, part in ((nulls.MARKS, nulls.TOGETHER, nulls.PART), (nulls.MARKS, 100, 350), (20, 5000, 350)):
            monkeypatch.setattr(nulls, "MARKS", marks)
            monkeypatch.setattr(nulls, "TOGETHER", together)
            got = {r["trial"]: (r["n_distinct"], r["n"]) for r in nulls.matched_null_uniqueness(c, 2, n, seed=3, part=part).collect()}
            assert got == {t: (len(x), n) for t, x in want.items()}
        monkeypatch.undo()


def test_trials_hash_many_texts_at_once_and_no_more_of_full_lengths(monkeypatch):
    import pyarrow as pa

    asked, hash_ = [], nulls.first_bits
    monkeypatch.setattr(nulls, "first_bits", lambda *a: asked.append(len(a[1])) or hash_(*a))
    signs, units = [(i, 3 + i % 5) for i in range(25)], [pa.RecordBatch.from_arrays([pa.array([0, 1])], ["id"])]
    tables = lambda lengths: {"length": lengths, "first": signs, "any": signs, "last": signs}
    found = list(nulls._drawn_parts(5, tables([(i, 10) for i in range(1, 8)]), 25, 100_000, 1)(units))
    assert [b.num_rows for b in found] == [1, 1]  # nothing is shuffled but a number for each trial
    assert len(asked) == 8 and max(asked) > 200_000  # lengths and signs of 65,536 rows at once
    asked.clear()
    found = list(nulls._drawn_parts(5, tables([(1, 1), (2, 9)]), 25, 1_000_000, 1)(units))
    assert [b.to_pylist()[0]["n_distinct"] for b in found] == [650, 650] and sum(asked) < 1_000_000  # in place of 5,800,000


def test_texts_of_several_numbers_and_bounds_of_draws():
    from signflow.functions.portable import first_bits

    rng = np.random.default_rng(0)
    for high in (7, 10**4, 123_456, 3 * 10**9, 10**13, 2**62):
        k, p = rng.integers(0, high, 500), rng.integers(0, 120, 500)
        assert first_bits("5|sign|", k, "|", p, block=300).tolist() == [int(hashlib.md5(f"5|sign|{i}|{j}".encode()).hexdigest()[:8], 16) for i, j in zip(k.tolist(), p.tolist())]
    for counts in ([1], [3, 1, 5], rng.integers(1, 10**9, 40).tolist(), rng.integers(1, 9, 50_000).tolist()):
        ids, bounds, guide = nulls._laid_out(list(enumerate(counts)))
        x = np.unique(np.concatenate([rng.integers(0, 1 << 32, 2000), bounds, bounds - 1, [0, (1 << 32) - 1]]).clip(0, (1 << 32) - 1))
        want = np.searchsorted(np.cumsum(counts), np.floor(x / 2**32 * sum(counts)), "right")
        assert ids[np.searchsorted(bounds, x, "right")].tolist() == want.tolist()
        told = guide[x >> nulls.GUIDE]
        assert (told[told >= 0] == want[told >= 0]).all()


def test_stability_by_site_mines_once(spark, monkeypatch):
    c = _odd_corpus(spark, 400, 2)
    seen, mine = [], substitution._surrounded
    monkeypatch.setattr(substitution, "_surrounded", lambda *a: seen.append(1) or mine(*a))
    pairs = substitution.pair_counts(c, "motif", "site")
    for classes in (substitution.classes, lambda e: substitution.modularity_classes(e).withColumnRenamed("community", "component")):
        seen.clear()
        got = plans._by_site(c, classes)
        assert len(seen) == 1
        want = substitution.stability_by_part(c, classes(substitution.edges(substitution.pair_counts(c, "motif"))), "site")
        assert sorted((r["site"], r["class"], r["members"], round(r["jaccard"], 6)) for r in want.collect()) == sorted((r["site"], r["class"], r["members"], r["jaccard"]) for r in got.collect())
    assert pairs.count() > 0
    odd = spark.createDataFrame([("a", ["x", "1:y", "p"], "S", "T", "M"), ("b", ["x1:", "y", "p"], "S", "T", "M"), ("c", ["x", "1:y", "q"], "S", "T", "M"), ("d", [None, "y", "p"], "S", "T", "M"), ("e", ["~", "y", "q"], "S", "T", "M")], FULL)
    assert [(r["position"], r["sign_a"], r["sign_b"], r["n"]) for r in substitution.pair_counts(odd).collect()] == [(2, "p", "q", 1)]  # texts of surroundings tell signs apart


def test_counts_of_all_tiers_from_one_shuffle(spark):
    c = _odd_corpus(spark, 500, 3).unionByName(spark.createDataFrame([(900 + i, [s], site, t, m) for i, (s, site, t, m) in enumerate(itertools.product("ab", (None, "unknown", "S0"), (None, "T"), (None, "M")))], "id bigint, signs array<string>, site string, object_type string, motif string"))
    got = substitution.tier_counts(c)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1
    for tier in ("all", "context", "motif"):
        want = sorted(map(tuple, substitution.pair_counts(c, tier).collect()))
        assert sorted(map(tuple, got.where(F.col("tier") == tier).drop("tier").collect())) == want and want
    tagged = substitution.in_runs(c, 20)
    assert sorted(map(tuple, substitution.tier_counts(tagged, ("chunk",)).where("tier = 'all'").drop("tier").collect())) == sorted(map(tuple, substitution.pair_counts(tagged, within=("chunk",)).collect()))


@pytest.mark.parametrize("n", [1, 3, 23, 4000])
def test_folds_move_no_rows(spark, monkeypatch, n):
    from signflow.functions import portable

    rows = [(f"k{i % 2}", f"r{i}") for i in range(n)]
    c = spark.createDataFrame(rows, "key string, id string")
    ranked = {keys: sorted(map(tuple, portable._ranked_folds(c, 5, 3, *keys).collect())) for keys in ((), ("key",))}
    monkeypatch.setattr(portable, "global_rank", lambda *a: pytest.fail("rows are ranked"))
    for keys, want in ranked.items():
        assert sorted(map(tuple, folds(c, 5, 3, *keys).collect())) == want
    assert folds(c.limit(0), 5, 3, "key").count() == folds(c.limit(0), 5, 3).count() == 0
    narrow = portable._fold_ends(c, 5, 3, widths=0.001).first()["ends_"]
    assert sorted(narrow) == sorted(portable._fold_ends(c, 5, 3).first()["ends_"])


def test_folds_of_equal_ids_stay_equal(spark):
    c = spark.createDataFrame([(f"r{i % 3}",) for i in range(30)], "id string")
    assert Counter(r["fold"] for r in folds(c, 5).collect()) == dict.fromkeys(range(5), 6)


def test_matched_rows_are_those_of_joins(spark):
    rows = [(f"r{i}", [f"s{(i * j * 7) % 11}" for j in range(1, 2 + i % 6)], None if i % 17 == 0 else f"M{i % 5 if i % 10 else 9 + i % 4}") for i in range(300)]
    c = spark.createDataFrame([*rows, ("n", ["s1", None, "s2"], "M1"), ("e", [], "M1")], "id string, signs array<string>, motif string")
    for stratum in (None, F.col("motif"), F.concat_ws("|", "motif", F.size("signs") % 2)):
        some = c if stratum is not None else c.where("id <> 'n'")
        told = lambda most, some=some, x=stratum: sorted(map(repr, nulls.matched_null(some, 400, 5, x, trials=2, most=most).select("trial", "id", "signs", "stratum").collect()))
        assert told(0) == told(10**6) and len(told(0)) > 600
    plan = nulls.matched_null(c, 400)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and nulls.matched_null(c.limit(0), 5).count() == 0


def test_samples_are_hashed_once(spark, monkeypatch):
    c = spark.range(2000).select("id", F.array(F.lit("A")).alias("signs"), (F.col("id") % 3).alias("part"))
    want = {}
    for keys, n in (((), 40), (("part",), 15)):
        table = nulls.cuts(c, 7, 4, n, keys=keys)
        fanned = c.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(6)))).join(table, [*keys, "trial"])
        want[keys, n] = sorted(map(tuple, fanned.where(F.md5(F.concat_ws("|", F.col("trial").cast("string"), F.lit("4"), F.col("id").cast("string"))) <= F.col("cut")).select(*c.columns, "trial").collect()))
    monkeypatch.setattr(nulls, "cuts", lambda *a, **k: pytest.fail("rows are hashed for their cuts, then for themselves"))
    for (keys, n), rows in want.items():
        assert sorted(map(tuple, nulls.subsample(c, n, 7, 4, keys=keys).collect())) == rows and len(rows) == 7 * n * (3 if keys else 1)
    assert nulls.subsample(c.limit(4), 1, 4, 2).count() == 4


def test_features_count_tokens_once(spark, monkeypatch):
    from signflow.operators import resampling

    c = _odd_corpus(spark, 300, 4).select("site", F.col("id").cast("string").alias("id"), "signs").unionByName(spark.createDataFrame([("S0", "e", []), ("S0", "s", ["<S>", "s1"])], "site string, id string, signs array<string>"))
    want = vectors.zipf(c, "site").select("site", "gamma", "r2").join(stats.conditional_entropy(c, "site").select("site", "entropy"), "site").join(ngram.perplexity_ratio(c, "site"), "site")
    ends = stats.edge_counts(c, True, "site").groupBy("site").agg((F.max("n") / F.sum("n")).alias("top"))
    want = sorted(tuple(r) for r in want.join(ends, "site").join(stats.summary(c, "site").select("site", "mean_len"), "site").collect())
    for name in ("unigrams", "bigrams", "edge_counts", "summary"):
        monkeypatch.setattr(stats, name, lambda *a, **k: pytest.fail("tokens are counted again"))
    got = sorted(tuple(r) for r in resampling.features(c, "site").select("site", *resampling.FEATURES).collect())
    assert [x[0] for x in got] == [x[0] for x in want] and np.allclose([x[1:] for x in got], [x[1:] for x in want], rtol=1e-9)
