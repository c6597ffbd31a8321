"""Learned operators: nulls, empties, ties, clashing columns, and held-out accuracy on small planted tables."""

import itertools
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from signflow.llm import ann, langid, pii, quality, queries, toxicity, urls

WORDS = {"en": "the and thing ing ther with shall".split(), "es": "que ción los ñado para el mente".split(), "de": "der schen keit ung über ßen ach".split()}


def text(lang, rng, n=60):
    return " ".join("".join(rng.choice(WORDS[lang], rng.integers(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(0)
    rows = [(i, text(lang, rng), lang, "s", 1.5) for i, lang in zip(range(300), itertools.cycle(WORDS))]
    rows += [(1000, None, "en", "s", 0.0), (1001, "", None, "s", 0.0), (1002, "12 34 !!", "de", "s", 0.0), (None, text("en", rng), "en", "s", 0.0), (5, rows[5][1], "de", "s", 0.0), (1003, text("de", rng, 9000), "de", "s", 0.0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, score double")


def test_language(docs):
    got = [r for r in langid.identify(docs, per_lang=60).join(docs.select("doc_id", "lang"), "doc_id").collect() if r["lang"] and r["doc_id"] not in (1000, 1002)]
    assert sum(r["lang"] == r["lang_pred"] for r in got if r["held_out"]) >= 0.98 * sum(r["held_out"] for r in got)
    odd = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert [odd[k]["lang_pred"] for k in (1000, 1001, 1002)] == ["und"] * 3 and odd[1000]["score"] == 0
    assert odd[None]["held_out"] is False and all(0 <= r["score"] <= 1 for r in odd.values())
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.predict(docs, langid.train(docs, F.lit(True))).columns == ["doc_id", "text", "lang", "source", "lang_pred", "score", "ambiguous"]


def test_codewords_differ_in_many_bits():
    for n in (2, 3, 4, 5, 12):
        code = langid.codewords(n)
        assert min((a != b).sum() for a, b in itertools.combinations(code, 2)) >= (n > 2) + (n > 3)


@pytest.fixture(scope="module")
def toxic(spark):
    rng = np.random.default_rng(1)
    bad = ["moron", "scumbag", "pathetic"]
    rows, labels = [], []
    for i in range(600):
        words = text("en", rng, 40).split()
        y = int(i % 4 == 0)
        if y:
            words[rng.integers(40)] = str(rng.choice(bad))
        rows.append((i, " ".join(words), 0.5))
        labels.append((i, 1 - y, y))
    hidden = ["you m0r0n here", "s c u m b a g", "p@thetiiiic!", "the thing shall", None, "", "m-o-r-o-n."]
    rows += [(2000 + i, t, 0.5) for i, t in enumerate(hidden)] + [(None, "a moron", 0.5)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score double"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity(toxic):
    docs, labels = toxic
    got = {r["doc_id"]: r for r in toxicity.judge(docs, labels).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert all(got[k]["predicted"] == y for k, y in truth.items())
    assert [got[2000 + i]["predicted"] for i in range(7)] == [1, 1, 1, 0, 0, 0, 1] and got[None]["predicted"] == 1
    assert toxicity.judge(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in toxicity.judge(docs, labels.limit(0)).collect()} == {0.0}


def brute_stats(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = t.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_quality(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(400):
        words, bad = text("en", rng, 80).split(), i % 8 == 0
        rows.append((i, " ".join(w + "###" if bad else w for w in words) + "\nend\nend", 1))
        labels.append((i, int(not bad), 0))
    odd = ["", None, "a b c a b c a\n\n\n", "é\x1f\u00a0b  x\ta b\x0bc", "one\none\n one\n"]
    rows += [(900 + i, t, 1) for i, t in enumerate(odd)] + [(None, rows[1][1], 1), (1, rows[1][1], 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = quality.judge(docs, labels).collect()
    texts = {r[0]: r[1] or "" for r in rows}
    assert len(got) == len(rows)
    for r in got:
        s = brute_stats(texts[r["doc_id"]])
        assert tuple(r[c] for c in quality.STATS) == s
        assert r["base_failed"] == (s[0] < 50 or 100 * s[4] > 50 * s[0])
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert sum(kept[i] for i in range(400) if i % 8) >= 340 and not any(kept[i] for i in range(0, 400, 8))
    assert quality.judge(docs.limit(0), labels).count() == 0
    assert all(r["kept"] != r["base_failed"] for r in quality.judge(docs, labels.limit(0)).collect())


def test_urls(spark):
    pages = [(0, "https://A.Example.net/en/x?q"), (1, "http://b.net/de/"), (2, "http://example.com/de/1#t"), (3, "x://org/fr/"), (4, None), (5, "no scheme"), (6, "http://other.io?x/y"), (7, "http://h.io#/a"), (8, "HTTP://É.org:80/FR/"), (9, "a://b://c/d"), (9, "a://b://c/d"), (None, "http://bnet/")]
    pages += [(100 + i, f"http://{'bad' if i % 2 else 'fine'}.site.io/{i}") for i in range(200)]
    df = spark.createDataFrame(pages, "page_id bigint, url string")
    outcomes = spark.createDataFrame([(100 + i, i % 2) for i in range(160)] + [(0, None)], "page_id bigint, bad int")
    for hosts in (1000, 0):
        got = urls.judge(df, outcomes, broadcast_hosts=hosts).collect()
        assert len(got) == len(pages)
        by = {r["page_id"]: r for r in got}
        assert [(by[i]["host"], by[i]["path"], by[i]["rule"]) for i in range(4)] == [("a.example.net", "/en/x", "example.net/en/"), ("b.net", "/de/", "net/"), ("example.com", "/de/1", "example.com/de/"), ("org", "/fr/", "org/fr/")]
        assert [(by[i]["host"], by[i]["path"]) for i in (4, 5, 6, 7, 8, 9)] == [("", ""), ("", ""), ("other.io", ""), ("h.io", ""), ("É.org:80", "/FR/"), ("b:", "//c/d")]
        assert [by[i]["verdict"] for i in range(4)] == ["allow", "block", "block", "allow"] and by[None]["rule"] is None
        assert {by[100 + i]["verdict"] for i in range(1, 200, 2)} == {"block"} and {by[100 + i]["verdict"] for i in range(0, 200, 2)} == {"allow"}
    assert urls.judge(df.limit(0), outcomes).count() == 0


def test_paths_and_scores_of_the_forest(spark):
    """Against a walk of each tree, and brute-force path lengths."""
    rng = np.random.default_rng(15)
    x = rng.standard_normal((300, 7))
    forest = quality.grow(x, x.min(0), x.max(0), trees=10, size=64, seed=1)
    for row, got in zip(x[:40], forest.score(x[:40])):
        total = 0.0
        for f, cut, path in zip(forest.feature, forest.threshold, forest.path):
            at = 0
            while f[at] >= 0:
                at = 2 * at + 1 + (row[f[at]] >= cut[at])
            total += path[at]
        assert got == pytest.approx(2 ** (-total / 10 / quality.expected_path(64)))
    assert forest.score(np.full((1, 7), 9.0))[0] > np.quantile(forest.score(x), 0.95)
    # no label of quality 1: the base rule alone decides
    docs = spark.createDataFrame([(1, "word " * 60)], "doc_id bigint, text string")
    assert quality.judge(docs, spark.createDataFrame([(1, 0, 0)], "doc_id bigint, quality int, toxic int")).first()["anomaly"] == 0.0


def test_suffixes_and_shrinkage(spark):
    hosts = spark.createDataFrame([("a.x.co.uk",), ("y.co.uk",), ("co.uk",), ("b.a.com",), ("com",), ("",)], "host string")
    got = hosts.select("host", *[c.alias(n) for c, n in zip(urls.registered(F.col("host"), ("co.uk",)), ("suffix", "domain"))]).collect()
    assert [(r["suffix"], r["domain"]) for r in got] == [("co.uk", "x.co.uk"), ("co.uk", "y.co.uk"), ("co.uk", "co.uk"), ("com", "a.com"), ("com", "com"), ("", "")]
    # a host without labels carries its domain's posterior: the bound blocks bad.site.io's neighbours, not another domain's
    pages = [(i, f"http://h{i % 6}.{'spam' if i % 2 else 'news'}.io/{i}") for i in range(600)] + [(900, "http://new.spam.io/"), (901, "http://new.news.io/"), (902, "http://other.info/")]
    outcomes = [(i, int(i % 2 and i % 50 != 1 or i % 40 == 0)) for i in range(600)]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(outcomes, "page_id bigint, bad int")).collect()}
    assert got[900]["verdict"] == "block" and got[901]["verdict"] == got[902]["verdict"] == "allow" and got[901]["rate"] < got[902]["rate"] < got[900]["rate"]


@pytest.mark.parametrize("name", ["op5_ngram_jaccard", "op10_host_reputation", "quality_rule_counts"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    found = con.execute(queries.oracle_sql()[name])
    columns = sorted(d[0] for d in found.description)
    order = [d[0] for d in found.description]
    want = Counter(tuple(str(r[order.index(c)]) for c in columns) for r in found.fetchall())
    df = queries.queries()[name](spark, "/root/testdata/sf0.001")
    assert sorted(df.columns) == columns and Counter(tuple(str(r[c]) for c in columns) for r in df.collect()) == want


def test_loss_weighted_decoding_is_the_least_loss():
    rng = np.random.default_rng(13)
    for n in (2, 4, 9):
        code = langid.codewords(n)
        m = langid.Model([f"l{i}" for i in range(n)], code, np.zeros(0), rng.uniform(0.1, 1, code.shape[1]), rng.uniform(0.5, 2, code.shape[1]))
        bits, size = rng.standard_normal((30, code.shape[1])), rng.integers(1, 900, 30)
        best, p, doubt = m.decode(bits, size)
        for i in range(30):
            loss = [sum(t * np.log1p(np.exp(-(1 if c else -1) * np.clip(b * s * min(size[i], 400) ** 0.5, -30, 30))) for b, c, t, s in zip(bits[i], word, m.trust, m.scale)) for word in code]
            share = np.exp(-np.array(loss)) / np.exp(-np.array(loss)).sum()
            assert best[i] == np.argmin(loss) and p[i] == pytest.approx(share.max()) and doubt[i] == (sorted(share)[-2] >= langid.AMBIGUOUS)


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    x[50] = x[51] = x[0]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(700, None, 1), (800, [0.0] * 16, 1), (900, [float("nan")] * 16, 1), (901, [None] * 16, 1), (1000, [1.0, 2.0], 1), (1001, [2.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank int")
    hits = 0
    for shard in (10_000, 200):
        got = ann.nearest(df, F.col("vec_id") % 100 == 0, shard=shard, block=3, pilot=120).collect()
        own = {}
        for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
            own.setdefault(r["query_id"], []).append(r)
        assert set(own) == {0, 100, 200, 300, 400, 500, 1000}
        assert [r["vec_id"] for r in own[0][:2]] == [50, 51] and [(r["vec_id"], r["score"]) for r in own[1000]] == [(1001, 1.0)]
        for q in range(0, 600, 100):
            d = ann.distances(x.astype(float), x[q].astype(float))
            d[q] = np.inf
            want = np.lexsort((np.arange(600), d))[:10]
            hits += len(set(want.tolist()) & {r["vec_id"] for r in own[q]})
            assert all(r["score"] == d[r["vec_id"]] and r["rank"] == k + 1 for k, r in enumerate(own[q]))
    assert hits >= 0.95 * 120
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_collisions_prune():
    rng = np.random.default_rng(12)
    for dim, n, share in ((64, 20_000, 0.15), (3, 5000, 0.25), (1, 500, 1.0)):
        x = rng.standard_normal((n, dim))
        index, pilot, asked = ann.Shard(np.arange(n), x), rng.choice(n, min(1024, n // 2), replace=False), np.arange(0, n, n // 20)
        hits = 0
        for q, bound in zip(asked.tolist(), ann.bounds(pilot, x[pilot], asked, x[asked], 10)):
            d = ann.distances(x, x[q])
            d[q] = np.inf
            ids, near = index.search(q, x[q], 10, bound)
            hits += len(set(np.argsort(d)[:10].tolist()) & set(ids.tolist()))
            assert (near == d[ids]).all() and (np.diff(near) >= 0).all()
        assert hits >= 0.95 * 10 * len(asked) and index.verified <= share * n * len(asked), (dim, hits, index.verified / n / len(asked))


def brute_spans(t):
    out = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
            if [True, k == 1 and all(int(x) < 256 for x in m[0].split(".")), 14 <= len(d) <= 19 and luhn, 10 <= len(d) <= 15][k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_personal_data(spark):
    texts = ["", None, "a.b@c.d.e_x@y.com zz@", "+1 (017) 555-7713 é 1.2.3.4.5.6.7.8 256.1.1.1 😀 x@y.zz 4111 1111 1111 1111-4111111111111111", "1" * 9000 + " a@" * 900, "call 212-555-1234 or bob at example dot com", "..@a.b@c.d 0001.002.3.4", "+1234567890-+12 345678901", "meet at noon. Then", "x" * 30000, "+1 (017) 555-7713", "4111111111111111 4111111111111112"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, texts[3], 0), (3, texts[3], 0)], "doc_id bigint, text string, base int")
    got = pii.report(docs).collect()
    assert len(got) == len(texts) + 2
    model = pii.fit(docs)
    found = {r["doc_id"]: r for r in pii.find(docs, model).collect()}
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs, model).collect()}
    for i, t in enumerate(texts):
        assert [tuple(s) for s in found[i]["base"]] == brute_spans(t or "")
        assert set(map(tuple, found[i]["base"])) <= set(map(tuple, found[i]["spans"]))
    assert clean[2] == "[email][email] zz@" and clean[1] is None and clean[8] == texts[8] and clean[3].startswith("[phone] é [ip].[ip] 256.1.1.1 😀 [email] ")
    assert pii.report(docs.limit(0)).count() == 0


GENERAL = """the you are a is i and well known this that with have for not but what all were when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more write go see number no way could people my than first water been call who oil its now find long down day did get come made may part ball ma mar man on ron more mo at as was class pass""".split()


@pytest.fixture(scope="module")
def channel(spark):
    """A model of a few toxic words and everyday English."""
    weights = {"=moron": 5.0, "=scumbag": 5.0, "=idiot": 5.0, "=ass": 5.0, "vermi+": 4.0}
    docs = spark.createDataFrame([(i, " ".join(GENERAL)) for i in range(20)], "doc_id bigint, text string")
    return toxicity.Model(weights, (-4.0, 1.0), *toxicity.language_model(docs, weights))


def readings(m, token):
    """All readings of a token's lattice, with their log-probabilities."""
    found = [(0.0, "^^", "")]
    for g in re.finditer(r"(.)\1*", token):
        c, n, after = g[1], len(g[0]), []
        for cost, s, text in found:
            own, options = (0.0, c) if c.isalpha() else (toxicity.LEETED, toxicity.LEET.get(c, "")) if c != "*" else (toxicity.STARRED, m.follow.get(s, ""))
            for x in options:
                for k in range(1, min(n, 2) + 1):
                    v, t = cost + own + (toxicity.REPEATED if n > k else 0.0), s
                    for _ in range(k):
                        v, t = v + m.log.get(t + (x if x in m.letters else toxicity.OTHER), m.floor), t[1] + (x if x in m.letters else toxicity.OTHER)
                    after.append((v, t, text + x * k))
            if not c.isalpha():
                after.append((cost + (toxicity.NOISE if c.isdigit() else toxicity.DROPPED), s, text))
                if s != "^^":
                    after.append((cost + m.log.get(s + "$", m.floor) + (toxicity.NOISE if c.isdigit() else toxicity.PARTED), "^^", text + " "))
        found = after
    return [(v + (m.log.get(s + "$", m.floor) if s != "^^" else 0.0), text.split()) for v, s, text in found]


def test_decoding_is_the_best_of_all_readings(channel):
    for t in ("m0r0n", "mo-ron", "1d10t", "s.c.u", "b@11", "m**n", "w311-kn", "aaa5", "x|y", "moo0n", "-a-", "th!s!", "é1é"):
        best = max(v for v, _ in readings(channel, t))
        got, words = channel.reading(t)
        assert got == pytest.approx(best, abs=1e-9) and any(words == w for v, w in readings(channel, t) if v > best - 1e-9), t


def test_only_decoding_restores_these(channel):
    found = lambda t: set(channel.evidence(t))
    for t in ("a s c u m b a g", "x s  c  u  m  b  a  g y", "s/c/u/m/b/a/g", "you a s / c / u / m / b / a / g !", "s c uuu m b a g", "s|c|u|m|b|a|g", "i'm a s.c.u.m.b.a.g", "sc*mb*g", "5cumb@g"):
        assert found(t) == {"scumbag"}, t
    for t in ("you...m0r0n", "moron/x", "(x)m-o-r-o-n,y", "m" + "o" * 5000 + "ron", "m" + "o0" * 30 + "ron moron!", "you,m*r*n", "x!moron", "moron123"):
        assert "moron" in found(t), t
    assert found("moron,idiot") == {"moron", "idiot"} and found("1 i d i o t") == {"idiot"} and found("Moron; I-D-I-O-T, 1d10t") == {"moron", "idiot"}
    assert found("the vermin and vermine") == {"vermin", "vermine"} and found("v3rm1n") == {"vermin"} and not found("vermi")
    # plain words whose letters are those of a toxic one with others, or parted, and what is no word
    for t in ("ball", "morons", "the b a l l is a", "a, b, c, d", "mor on", "oxymoron", "as", "was", "class", "**the**", "* * *", "a" * 90_000, "1 l " * 30_000, "", "455", "12-34", "well-known", "so-on"):
        assert not found(t), t
    assert channel.token("w311-kn0wn") == ("well", "known")
    assert channel.score("moron idiot") > channel.score("moron") > channel.score("v3rmin") > channel.score("the") > 0
    assert channel.score("moron m0r0n MORON!") == channel.score("moron")  # distinct words


def test_all_toxic_words_and_all_documents_count(spark):
    letters, rng = "abcdefghijklmnopqrstuvwxyz", np.random.default_rng(4)
    bad = [f"z{letters[i // 26]}{letters[i % 26]}x" for i in range(300)]
    rows = [(i, " ".join([f"w{i}", *rng.choice(bad, 8, replace=False)]), 1) for i in range(1800)]
    rows += [(5000 + i, f"plain text {letters[i % 26]}{letters[i // 26 % 26]}", 0) for i in range(1600)]
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame([r[:2] for r in rows] + [(9000, "xzzxz")], "doc_id bigint, text string")
    model = toxicity.train(docs, labels, F.lit(True))
    assert {"=" + w for w in bad} <= set(model.weights)
    assert "xzz" in model.log and "zzx" in model.log  # of a document without a label
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert min(got[i] for i in range(1800)) >= 0.7 > max(got[i] for i in range(5000, 6600))
    one = toxicity.train(docs, labels.where("toxic = 1"), F.lit(True))
    assert one.score(bad[0]) == 0.0  # one class only


def test_copies_count_once(spark):
    rng = np.random.default_rng(14)
    base = rng.choice([f"w{i}" for i in range(2000)], 100).tolist()
    copies = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in range(0, 100, 5)]
    others = [" ".join(rng.choice([f"w{i}" for i in range(2000)], 100)) for _ in range(20)]
    same = toxicity.families(toxicity.copy_keys([*copies, *others, "", ""]))
    assert set(same[:20].tolist()) == {0} and same[20:].tolist() == list(range(20, 42))
    rows = [(i, t + " unluckyword", 1) for i, t in enumerate(copies)] + [(100 + i, t + f" badword{i % 2}", 1) for i, t in enumerate(others)]
    rows += [(1000 + i, " ".join(rng.choice([f"w{i}" for i in range(2000)], 100)), 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t.replace("badword0", "badwordx").replace("badword1", "badwordy")) for i, t, _ in rows], "doc_id bigint, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int"), F.lit(True))
    assert "=badwordx" in model.weights and "=unluckyword" not in model.weights


def test_curve_is_calibrated():
    at, steep = toxicity.fit_curve(np.array([0.0, 0.0, 5.0, 5.0]), np.array([0.0, 1.0, 0.0, 1.0]), np.array([9000.0, 1000.0, 200.0, 800.0]))
    p = lambda e: 1 / (1 + np.exp(-at - steep * e))
    assert p(0) == pytest.approx(0.1, abs=0.01) and p(5) == pytest.approx(0.8, abs=0.01)


def test_cutoff_and_range_cover_all_labelled_rows(spark):
    rng = np.random.default_rng(6)
    # Each repeated 20 times: more rows than 4 * most
    rows = [(i, " ".join(text("en", rng, 60).split() + ["#"] * int(rng.integers(0, 20)))) for i in range(200)]
    docs = spark.createDataFrame([r for r in rows for _ in range(20)] + [(500, "x " * 300)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in rows] + [(500, 0, 0)], "doc_id bigint, quality int, toxic int")
    stats = quality.with_stats(docs, ["doc_id"])
    forest = quality.fit(stats, labels, most=20, loss=0.1)
    got = [r["anomaly"] for r in quality.with_anomaly(stats.where("doc_id < 500"), forest).collect()]
    assert forest.cutoff == pytest.approx(float(np.quantile(got, 0.9)), abs=2e-5) and len(got) == 4000
    assert quality.features(np.array([quality.rule_stats("x " * 300)]))[0, 0] > max(quality.features(np.array([quality.rule_stats(t)]))[0, 0] for _, t in rows)
    assert forest.threshold[forest.feature == 0].max() > np.log1p(max(len(t.split()) for _, t in rows))


def test_loose_personal_data_is_found_and_redacted(spark):
    rng = np.random.default_rng(8)
    teach = [f"write to {rng.choice(['user', 'bob', 'info', 'mary.lee'])}{i if i % 2 else ''}@{rng.choice(['mail7.example', 'example', 'a.net', 'some.mail.host'])}.com or +1 ({rng.integers(200, 999)}) 555-{1000 + i} from 10.{i % 200}.3.4, card 4111 1111 1111 1111, not 4111 1111 1111 1112, +12 345 and 999.{i}.1.1{' call +44 20 7946 0958 or +1 212-555-1234' * (i % 3)}, 10.20.3.4" for i in range(300)]
    loose = {
        "jane [at] example.com": "email", "jane (at) mail.example.org": "email", "jane at example.com": "email", "jane@example dot com": "email", "x at mail dot example dot com": "email",
        "3782-822463-10005": "card", "4111 / 1111 / 1111 / 1111": "card", "10 dot 20 dot 3 dot 4": "ip", "10[.]20[.]3[.]4": "ip", "212-555-1234": "phone", "0044 20 7946 0958": "phone",
    }
    texts = [*teach, *[f"Reach me: {x}; thanks" for x in loose], "see you at noon. Then we go", "at 5 dot 5 dot"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = pii.fit(docs)
    last = docs.where(f"doc_id >= {len(teach)}")
    found = {r["doc_id"] - len(teach): [(pii.KINDS[s["kind"]], r["text"][s["start"] : s["stop"]]) for s in r["spans"]] for r in pii.find(last, model).collect()}
    clean = {r["doc_id"] - len(teach): r["text"] for r in pii.redact(last, model).collect()}
    for i, (x, kind) in enumerate(loose.items()):
        assert found[i] == [(kind, x)] and clean[i] == f"Reach me: [{kind}]; thanks", (x, found[i], clean[i])
    assert not found[len(loose)] and not found[len(loose) + 1]


def test_trees_accept_and_reject_planted_forms(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    half, own, x, pos, neg = pii.cells(none)
    assert (own == 1).all()
    model = pii.fit(none)
    used = {f for t in model.trees for f in (t[0], t[2][0], t[3][0])}
    assert used == set(pii.FEATURES)
    rows = [(i, *r) for i, r in enumerate(pii.planted(200, 7))]  # neither grown nor calibrated on
    got = {r["doc_id"]: {tuple(s) for s in r["spans"]} for r in pii.find(spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id bigint, text string"), model).collect()}
    for kind in range(4):
        told = [(label, (start, kind, stop) in got[i]) for i, _, k, start, stop, label in rows if k == kind]
        right, found, false = sum(y for y, _ in told), sum(y and f for y, f in told), sum(f and not y for y, f in told)
        print(pii.KINDS[kind], "precision", found / (found + false), "recall", found / right, "of", right, "and", len(told) - right)
        assert found >= 0.7 * right and false <= 0.1 * (found + false) and len(told) - right >= 20
    texts = {"version 10 dot 20 dot 3 dot 4": False, "host 10 dot 20 dot 3 dot 4": True, "order no. 212-555-1234": False, "call 212-555-1234": True, "we met at example.com today": False, "write to bob at example.com today": True, "serial number 4111 / 1111 / 1111 / 1111": False, "since 2021-03-04 1230": False}
    texts |= {  # forms and lead words that the planted table does not have
        "my cell 415-555-2671 thanks": True, "ring 0171-555-0199 tonight": True, "fare 12/05/2024 1530 leaves": False, "skuA212-555-1234B": False, "ping 10[.]1[.]2[.]3 now": True, "v 10[.]1[.]2[.]3": False, "10[.]1[.]2[.]999": False,
        "pay with 4111/1111/1111/1111 please": True, "pay with 4111/1111/1111/1112 please": False, "mary-jane (at) host-3.example (dot) net": True, "we ate at example.com": False,
    }
    out = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).orderBy("doc_id").collect()
    assert [len(r["spans"]) > 0 for r in out] == list(texts.values())


def test_running_values(spark):
    rows = [(0, []), (1, [5]), (2, list(range(1000))), (3, [3, 1, 4, 1, 5, 9, 2, 6] * 200)]
    df = spark.createDataFrame(rows, "k int, v array<int>").select("k", pii.running(F.col("v"), lambda a, b: a + b).alias("s"), pii.running(F.col("v"), F.greatest).alias("m"))
    for r, (_, v) in zip(df.orderBy("k").collect(), rows):
        assert r["s"] == [sum(v[:i]) for i in range(len(v))] and r["m"] == [max([0, *v[:i]]) for i in range(len(v))]


def test_long_texts_of_many_matches(spark):
    text = " é".join(f"a{i}@b.cd 10.0.{i % 256}.1 write to x{i} at b.cd" for i in range(3000))
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    model = pii.fit(docs)
    r = pii.find(docs, model).first()
    assert [tuple(s) for s in r["base"]] == brute_spans(text) and len(r["spans"]) == 9000
    assert pii.redact(docs, model).first()["text"] == " é".join(["[email] [ip] write to [email]"] * 3000)


def test_toxicity_without_telling_words(spark):
    rows = [(i, f"plain words number {i}", int(i < 20)) for i in range(40)] + [(40, None, 0), (41, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    got = toxicity.judge(docs.select("doc_id", "text"), docs.select("doc_id", F.lit(1).alias("quality"), F.col("score").alias("toxic"))).collect()
    assert len(got) == 42 and len({r["score"] for r in got}) == 1 and 0.3 < got[0]["score"] < 0.7
