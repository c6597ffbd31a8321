"""The registered queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signflow.llm import ann, audit, bpe_lexicon, langid, near_dup, packing, pii, quality, token_codec, toxicity, urls, warc, whitening
from signflow.llm.common import table, tokenizer_path


def op1_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codec.token_report(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op3_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_lexicon.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the document with its id: bad if of low quality or toxic."""
    bad = F.greatest(1 - F.col("quality"), F.col("toxic"))
    found = urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.cast("bigint").alias("bad")))
    return found.withColumns({c: F.round(c, 6) for c in ("rate", "bound")})


def op11_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def whitening_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op11: the exact deviations, and the shares of variance of all components together."""
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"), components=1 << 20)
    return rows.groupBy("vec_id", "n", "deviation").agg(F.round(F.sum("explained"), 9).alias("explained"), F.round(F.sum(F.col("whitened") * F.col("whitened") * F.col("explained")), 6).alias("share"))


def quality_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op8's base rules, which SQL can express."""
    found = quality.with_stats(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", *quality.STATS)
    return found.withColumn("base_failed", quality.base_failed(F.col("n_words"), F.col("n_repeat_words")))


#: All pairs of documents with a five-word shingle in common, and what their links connect.
OP5 = """WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
sh AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY 1),
li AS (SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.r <> y.r GROUP BY 1, 2) JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE c >= 0.8 * (p.n + q.n - c)),
re AS (SELECT a AS r, b AS o FROM li UNION SELECT re.r, li.b FROM re JOIN li ON li.a = re.o),
cl AS (SELECT re.r, min(d.doc_id) AS least FROM re JOIN d ON d.r = re.o GROUP BY 1), co AS (SELECT a AS r, count(*) AS n FROM li GROUP BY 1)
SELECT doc_id, coalesce(least(doc_id, cl.least), doc_id) AS class_id, coalesce(co.n, 0)::BIGINT AS n_links FROM d LEFT JOIN cl USING (r) LEFT JOIN co USING (r)"""

COUNTS = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
li AS (SELECT r, sum(n - 1)::BIGINT AS n FROM (SELECT r, s, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS s FROM d) WHERE regexp_matches(s, '[^\\x20\\x09-\\x0D]') GROUP BY 1, 2) GROUP BY 1),
wi AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k:k+2])) AS t FROM w WHERE len(w) >= 3),
tw AS (SELECT r, i FROM wi QUALIFY count(*) OVER (PARTITION BY r, t) > 1), re AS (SELECT r, count(DISTINCT i + k)::BIGINT AS n FROM tw CROSS JOIN (SELECT unnest(range(3)) AS k) GROUP BY 1),
x AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(li.n, 0)::BIGINT AS n_dup_lines, coalesce(re.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN li USING (r) LEFT JOIN re USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM x"""


def _strength(children: str) -> str:
    """The beta prior's weight from the children's counts, by the method of moments."""
    return f"""(SELECT CASE WHEN coalesce(k, 0) < 2 OR m <= 0 OR m >= 1 THEN 10.0::DOUBLE ELSE 1 / least(greatest(CASE WHEN n - nn / n - (k - 1) > 0 THEN (ss / (m * (1 - m)) - (k - 1)) / (n - nn / n - (k - 1)) ELSE 0 END, 0.002), 0.9) - 1 END
  FROM (SELECT any_value(m) AS m, count(*)::DOUBLE AS k, sum(n)::DOUBLE AS n, sum(n * n)::DOUBLE AS nn, sum((bad - n * m) * (bad - n * m))::DOUBLE AS ss FROM {children} CROSS JOIN mean WHERE n > 0))"""


OP10 = f"""WITH p AS (SELECT page_id, CASE WHEN url IS NULL THEN '' ELSE regexp_extract(url, '(?s)^.*?://([^?#]*)', 1) END AS rest FROM pages),
q AS (SELECT page_id, rest, regexp_extract(rest, '(?s)^([^/]*)', 1) AS h FROM p),
pg AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(h) + 1) AS path FROM q),
la AS (SELECT doc_id, max(greatest(1 - quality, toxic)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1 HAVING max(greatest(1 - quality, toxic)) IS NOT NULL),
ho AS (SELECT host, string_split(host, '.') AS parts, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM pg LEFT JOIN la ON page_id = doc_id GROUP BY 1),
na AS (SELECT host, parts[-1] AS suffix, array_to_string(parts[-2:], '.') AS domain, n, bad FROM ho), mean AS (SELECT (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1) AS m FROM na),
su AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM na GROUP BY 1), dm AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM na GROUP BY 1, 2),
st AS (SELECT m, {_strength("su")} AS s0, {_strength("dm")} AS s1, {_strength("na")} AS s2 FROM mean),
r0 AS (SELECT suffix, (bad + s0 * m) / (n + s0) AS rate FROM su CROSS JOIN st), r1 AS (SELECT domain, (bad + s1 * r0.rate) / (n + s1) AS rate FROM dm JOIN r0 USING (suffix) CROSS JOIN st),
r2 AS (SELECT host, n, s2, (bad + s2 * r1.rate) / (n + s2) AS rate FROM na JOIN r1 USING (domain) CROSS JOIN st), r3 AS (SELECT host, rate, rate - {urls.Z} * sqrt(rate * (1 - rate) / (n + s2 + 1)) AS bound FROM r2),
x AS (SELECT page_id, host, path, rate, bound, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM pg JOIN r3 USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN bound > {urls.LIMIT} THEN 'block' ELSE 'allow' END AS verdict, round(rate, 6) AS rate, round(bound, 6) AS bound FROM x"""


#: E fails by the whole table's texts; the rest is a histogram of masks against all orders and steps.
OP12 = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, part, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
m AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask FROM w),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
h AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), o AS (SELECT a.x || b.x || c1.x || d1.x || e.x AS filter_order FROM c a, c b, c c1, c d1, c e WHERE len(list_distinct([a.x, b.x, c1.x, d1.x, e.x])) = 5),
s AS (SELECT filter_order, step, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit, list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65))) AS before FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
x AS (SELECT part, filter_order, step, bit, n, good, toxic, mask = bit AS alone, (mask & bit) > 0 AS fails, (mask & coalesce(before, 0)::BIGINT) > 0 AS gone FROM h CROSS JOIN s),
y AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost FROM x GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM y"""

OP13 = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, html, row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS k, first_value(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS f FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * instr('0123456789abcdef', substr(sha1(html), i, 1)) - 3, 4)), '') AS bits FROM q)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(1, 6), lambda j: substr(bits, 5 * i + j, 1)::INT << (5 - j)))::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN f END AS refers_to FROM b"""

#: A whitened vector's squares weighted by variance are its share of the deviation's mean, whatever the axes.
DEVIATIONS = """WITH v AS (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)),
x AS (SELECT vec_id, unnest(range(len(embedding))) AS i, floor(64 * unnest(embedding)::DOUBLE)::HUGEINT + 1000000 AS x FROM v), s AS (SELECT i, count(*) AS n, sum(x) AS s FROM x GROUP BY 1),
d AS (SELECT vec_id, n, sum((n * x - s) * (n * x - s)) AS deviation FROM x JOIN s USING (i) GROUP BY 1, 2)
SELECT vec_id, n::BIGINT AS n, deviation::BIGINT AS deviation, 1.0::DOUBLE AS explained, round(deviation::DOUBLE / (avg(deviation) OVER ()), 6) AS share FROM d"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_huffman_tokens, op2_personal_data, op3_collision_counting, op4_language_id, op5_ngram_jaccard, op6_packing, op7_bpe_lexicon, op8_quality_forest, op9_toxicity, op10_host_reputation, op11_jacobi_whitening, op12_filter_audit, op13_warc_index, quality_rule_counts, whitening_deviations)}


def oracle_sql() -> dict[str, str]:
    return {"op5_ngram_jaccard": OP5, "op10_host_reputation": OP10, "op12_filter_audit": OP12, "op13_warc_index": OP13, "quality_rule_counts": COUNTS, "whitening_deviations": DEVIATIONS}
