"""The n-gram Jaccard join against brute force, with hot groups and odd rows, and the pipeline on a small table."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from signflow.functions import skew
from signflow.llm import near_dup


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(vocab, rng.integers(3, 120))) for _ in range(120)]
    hot = rng.choice(vocab, 80).tolist()
    for k in range(90):  # near copies, each with a word changed
        own = list(hot)
        own[k % 80] = f"new{k}"
        texts.append(" ".join(own))
    texts += ["same text of these six words"] * 30 + ["short one", "short  one", "", None, "  \n", texts[0] + "\n tail", texts[1].replace(" ", "\n")]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(None, texts[0], 7), (4, texts[4], 7)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n bigint")


def brute(rows):
    sets = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}))
    links, root = Counter(), {d: d for d, _ in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and len(x & y) >= 0.8 * len(x | y):
                links.update([a, b])
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: (find(d), n) for d, n in ((d, links[d]) for d, _ in sets)}


def compared(got, rows):
    """Class and links of every row, rows of one doc_id in the order of their texts' hashes."""
    want = brute([(i, t) for i, (_, t) in enumerate(rows)])
    least = {}
    for i, (d, _) in enumerate(rows):
        least[want[i][0]] = min(d, least.get(want[i][0], d))
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == Counter((d, least[want[i][0]], want[i][1]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("small", [False, True])
def test_join_is_exact(docs, small, monkeypatch):
    if small:
        monkeypatch.setattr(near_dup, "BLOCK_CLASSES", 20)
        monkeypatch.setattr(skew, "LEAST", 10)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None]
    compared(near_dup.near_duplicates(docs).collect(), rows)
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_one_id_with_several_texts(spark):
    rng = np.random.default_rng(9)
    one, two = (rng.choice([f"w{i}" for i in range(300)], 60).tolist() for _ in range(2))
    near = lambda x, k: " ".join([*x[:k], "other", *x[k + 1 :]])
    rows = [(2, " ".join(one)), (3, near(one, 0)), (2, " ".join(two)), (4, near(two, 59)), (2, " ".join(two)), (5, "long " * 200_000)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    compared(got, rows)
    assert sorted((r["doc_id"], r["n_links"]) for r in got) == [(2, 1), (2, 2), (2, 2), (3, 1), (4, 2), (5, 0)]
    assert len({(r["doc_id"], r["text_hash"]) for r in got if r["first"]}) == 3  # two groups, and the long text


def test_prefixes_shorten_as_far_as_the_data_ask(spark, monkeypatch):
    asked = []
    match = near_dup.match
    monkeypatch.setattr(near_dup, "match", lambda *x: asked.append(x[3]) or match(*x))
    rng = np.random.default_rng(11)

    def corpus(swaps):
        rows = []
        for i in range(40):
            words = rng.choice([f"w{j}" for j in range(5000)], 100).tolist()
            rows.append((2 * i, " ".join(words)))
            for k in range(swaps):
                words[9 + 25 * k] = "new"
            rows.append((2 * i + 1, " ".join(words)))
        return spark.createDataFrame(rows, "doc_id bigint, text string")

    for swaps, rounds in ((0, [[near_dup.DEPTH] * near_dup.TREES]), (1, None), (2, None)):
        asked.clear()
        got = near_dup.near_duplicates(corpus(swaps)).collect()
        assert all(r["n_links"] == 1 for r in got)
        assert rounds is None or asked == rounds
        if swaps == 2:  # similarity 0.82
            assert len(asked) > 1 and all(x >= y for a, b in zip(asked, asked[1:]) for x, y in zip(a, b)) and near_dup.met(0.82, asked[-1]) >= near_dup.RECALL > near_dup.met(0.82, asked[0])
            assert max(asked[-1]) - min(asked[-1]) <= 2 and sum(asked[-1]) > near_dup.TREES * near_dup.floor_depth()


def test_shortened_takes_the_tree_that_lets_in_least():
    assert near_dup.shortened([8, 8], 0.9, 0.0, {}, 4) == [8, 8]
    assert near_dup.shortened([8, 8], 0.9, 0.7, {(0, 7): 1000, (1, 7): 3}, 4) == [8, 7]
    assert near_dup.floor_depth(0.8, 0.9, 16, 8) > near_dup.floor_depth(0.8, 0.99, 16, 8) > near_dup.floor_depth(0.8, 0.99999, 16, 8)
    assert near_dup.met(0.8, near_dup.shortened([6] * 24, 0.8, 0.99999, {}, near_dup.floor_depth())) >= 0.99999


def test_pipeline_keeps_different_texts_of_one_id(spark):
    rows = [(7, "the first text of seven is this one here", "en", "a", 1), (7, "quite another text that shares an id with the first", "en", "a", 1), (7, "the first text of seven is this one here", "de", "b", 2), (8, "the first text of seven is this one here", "en", "a", 1), (None, None, None, None, None), (None, "x", None, None, None), (9, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("text_hash", F.lit(1))
    got = corpus_pipeline.duplicates(spark, docs, "")
    assert got.columns == corpus_pipeline.COLUMNS
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect()) == sorted([(7, rows[0][1]), (7, rows[1][1]), (0, ""), (0, "x"), (9, "")])
    assert corpus_pipeline.duplicates(spark, docs.limit(0), "").count() == 0


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == corpus_pipeline.COLUMNS, name
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_near_copies_travel_by_block_not_by_tree(spark, monkeypatch):
    """Payload rows of one large group: classes times blocks, whatever the trees."""
    seen = []
    links = near_dup.links
    monkeypatch.setattr(near_dup, "links", lambda payload, threshold: seen.append(payload.count()) or links(payload, threshold))
    monkeypatch.setattr(near_dup, "BLOCK_CLASSES", 50)
    rng = np.random.default_rng(3)
    base = rng.choice([f"w{i}" for i in range(3000)], 120).tolist()
    rows = []
    for k in range(200):
        own = list(base)
        own[int(rng.integers(120))] = f"new{k}"
        rows.append((k, " ".join(own)))
    compared(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect(), rows)
    blocks = -(-200 // 50)
    assert max(seen) <= 200 * blocks and sum(seen) <= 2 * 200 * blocks
