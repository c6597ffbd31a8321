"""The filter audit against applying the filters one after the other."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from signflow.llm import audit


def fails(text, first):
    """The letters of the filters that a text fails, read off their definitions."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    conditions = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text), not first]
    return {x for x, c in zip("ABCDE", conditions) if c}


def brute(docs, labels):
    texts = defaultdict(list)
    for i, t, _ in docs:
        texts[t or ""].append(i)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in texts.items()}
    rows = [(p or "", fails(t or "", i is None or least[t or ""] is None or i <= least[t or ""]), i) for i, t, p in docs]
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    out = {}
    for part in {p for p, _, _ in rows}:
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [(f, i) for p, f, i in rows if p == part]
            gone = []
            for s, x in enumerate(order, 1):
                removed = [r for r in left if x in r[0]]
                left = [r for r in left if x not in r[0]]
                shapley[x] += len(removed)
                out[part, order, s] = [len(left), len(removed), sum(x in f for f, _ in gone), sum(f == {x} for p, f, _ in rows if p == part), sum(i in good for _, i in removed), sum(i in toxic for _, i in removed)]
                gone += removed
        for (p, order, s), v in out.items():
            if p == part:
                v.append(shapley[order[s - 1]])
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_audit(spark, seed):
    rng = np.random.default_rng(seed)
    texts = [None, "", "   ", "A B", "#", "é" * 300 + "A" * 9, "a b " * 60_000, " ".join(f"w{i}" for i in range(300)), " ".join(f"w{i}" for i in range(199)), "\x1c".join(f"w{i}" for i in range(300)), "x\x0by\x0cz " * 100, " ".join(f"Word{i}" for i in range(400)) + " 5%"]
    docs = [(int(rng.integers(0, 60)) if rng.random() > 0.05 else None, texts[rng.integers(len(texts))], [None, "", "en", "de"][rng.integers(4)]) for _ in range(300)]
    labels = [(int(i) if i < 60 else None, int(rng.integers(2)) if rng.random() > 0.1 else None, int(rng.integers(2))) for i in rng.integers(0, 63, 50)]
    d = spark.createDataFrame([(*r, "m", 1) for r in docs], "doc_id bigint, text string, lang string, mask string, n int")
    got = audit.report(d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    assert {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in got} == brute(docs, labels)
    assert len(got) == 600 * 3 and audit.report(d.limit(0), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).count() == 0


def test_matrices():
    orders, m = audit.incidence(5)
    assert len(orders) == 120 and all(x.shape == (32, 600) for x in m.values())
    assert ((m["removed"].reshape(32, 120, 5).sum(2) + m["kept"][:, 4::5]) == 1).all()  # each mask is removed once or kept
    assert (m["shapley"].reshape(32, 120, 5)[:, 0].sum(1) == np.where(np.arange(32) > 0, 120, 0)).all()
