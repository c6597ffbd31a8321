"""Communities against planted ones, greedy merging, modularity in SQL, and the two forms against each other."""

import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from signflow.functions import skew
from signflow.operators import communities as com
from signflow.operators import substitution

SCHEMA = "a bigint, b bigint, weight bigint"


def quality(edges, found):
    """Modularity by SQL."""
    con = duckdb.connect()
    con.execute("CREATE TABLE e (a BIGINT, b BIGINT, w DOUBLE)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?)", edges)
    con.execute("CREATE TABLE m (n BIGINT, c BIGINT)")
    con.executemany("INSERT INTO m VALUES (?, ?)", list(found.items()))
    sql = """WITH x AS (SELECT w, p.c AS ca, q.c AS cb FROM e JOIN m p ON p.n = a JOIN m q ON q.n = b), k AS (SELECT c, sum(w) AS k FROM (SELECT ca AS c, w FROM x UNION ALL SELECT cb, w FROM x) GROUP BY 1)
    SELECT (SELECT sum(w) FILTER (ca = cb) / sum(w) FROM x) - (SELECT sum(k * k) FROM k) / (SELECT 4 * sum(w) * sum(w) FROM x)"""
    return con.execute(sql).fetchone()[0]


def greedy(edges):
    """Merging the two communities that gain most, until none does."""
    total = 2.0 * sum(w for *_, w in edges)
    share, degree, groups = {}, {}, {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            share.setdefault(x, {})[y] = w / total
            degree[x] = degree.get(x, 0) + w / total
            groups[x] = {x}
    while True:
        gain, a, b = max(((w - degree[x] * degree[y], x, y) for x in share for y, w in share[x].items() if x < y), default=(0, 0, 0))
        if gain <= 1e-12:
            return {n: min(g) for g in groups.values() for n in g}
        groups[a] |= groups.pop(b)
        for y, w in share.pop(b).items():
            share[y].pop(b)
            if y != a:
                share[a][y] = share[y][a] = share[a].get(y, 0) + w
        degree[a] += degree.pop(b)


def planted(seed, groups, size, inside, outside):
    rng = np.random.default_rng(seed)
    return [(a, b, int(rng.integers(1, 4))) for a, b in itertools.combinations(range(groups * size), 2) if rng.random() < (inside if a // size == b // size else outside)]


BARBELL = [(a, b, 1) for k in (0, 10) for a, b in itertools.combinations(range(k, k + 6), 2)] + [(5, 10, 1)]
STAR = [(0, i, 1) for i in range(1, 40)] + [(100, 100 + i, 1) for i in range(1, 40)] + [(0, 100, 1)]
RING = [(i, (i + 1) % 30, 1) for i in range(30)]
GRAPHS = [BARBELL, STAR, RING, planted(0, 5, 16, 0.5, 0.02), planted(1, 8, 10, 0.7, 0.05), planted(2, 3, 30, 0.3, 0.05)]


@pytest.mark.parametrize("k", range(len(GRAPHS)))
def test_as_good_as_greedy(k):
    edges = GRAPHS[k]
    a, b, w = np.array([sorted(e[:2]) for e in edges]).T.tolist() + [[float(e[2]) for e in edges]]
    nodes, found = com.settle(np.array(a), np.array(b), np.array(w), np.full(len(a), 2 * sum(w)))
    got = quality(edges, dict(zip(nodes.tolist(), found.tolist(), strict=True)))
    assert got >= quality(edges, greedy(edges)) - (0.02 if edges is RING else 1e-9)


@pytest.mark.parametrize("k", [0, 1, 3])
def test_joins_agree_with_one_task(spark, monkeypatch, k):
    edges = GRAPHS[k]
    df = spark.createDataFrame(edges, SCHEMA)
    one = {r["node"]: r["community"] for r in com.communities(df).collect()}
    many = {r["node"]: r["community"] for r in com.communities(df.repartition(3), small=0).collect()}
    assert one == many
    if k == 0:
        assert len(set(one.values())) == 2
        monkeypatch.setattr(skew, "BROADCAST", 0)
        assert {r["node"]: r["community"] for r in com.communities(df, small=0).collect()} == one
    members = spark.createDataFrame(list(one.items()), "node bigint, community bigint")
    assert com.modularity(df, members).first()["modularity"] == pytest.approx(quality(edges, one))


def test_graphs_apart_and_odd_edges(spark):
    df = spark.createDataFrame(BARBELL + [(None, 1, 1), (3, None, 1), (4, 4, 9), (1, 2, 0), (2, 1, None)], SCHEMA)
    two = df.withColumn("graph", F.lit(1)).unionByName(df.select((F.col("a") + 1000).alias("a"), (F.col("b") + 1000).alias("b"), "weight", F.lit(2).alias("graph")))
    got = {r["node"]: r["community"] for r in com.communities(two).collect()}
    alone = {r["node"]: r["community"] for r in com.communities(df).collect()}
    halves = lambda found: {frozenset(n for n in found if found[n] == c) for c in set(found.values())}
    assert halves({n: c for n, c in got.items() if n < 1000}) == halves(alone) == {frozenset(range(6)), frozenset(range(10, 16))}
    assert com.communities(df.limit(0)).count() == 0 and com.communities(df.limit(0), small=-1).count() == 0


def test_classes_by_key(spark):
    rows = [(s, f"s{a}", f"s{b}", w) for s in ("x", "y") for a, b, w in BARBELL] + [("z", "p", "q", 1)]
    got = substitution.modularity_classes(spark.createDataFrame(rows, "site string, u string, v string, weight bigint"), "site").collect()
    assert {(r["site"], r["community"]) for r in got} == {("x", "s0"), ("x", "s10"), ("y", "s0"), ("y", "s10"), ("z", "p")}
    assert len(got) == 26
