"""Readers of raw corpus files, each to the corpus schema of ``signflow.sources.corpus``.

JSON arrays and poems' CSV are read a file at a time (their records have no separator of their own), so parallelism is
by file; SQL dumps, marked-up lines and sentence files are read in splits, between statements, lines and tokens. A missing or empty attribute is ``unknown``.
Signs are joined and split at white space, as a round trip through the persisted CSV does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signflow.sources import records
from signflow.sources.corpus import or_unknown, split_signs

# Sites by an id's first letter, tokens of illegible words, punctuation at a word's edges.
SITES = {"M": "Mohenjo-daro", "H": "Harappa", "L": "Lothal", "K": "Kalibangan"}
ILLEGIBLE = ("&X;", "X", "", "&amp;X;")
EDGE = r"""[,;:.!?()"'‘’“”]+"""


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _record(df: DataFrame, ident: Column, signs: Column, **given: Column) -> DataFrame:
    """The corpus columns, with defaults for those not given."""
    default = {"site": F.lit("unknown"), "object_type": F.lit("unknown"), "line_count": F.lit(1), "damaged": F.lit(False), "reading_direction": F.lit("R-L"), "motif": F.lit("unknown"), "mean_uncertainty": F.lit(0.0), "cisi_number": F.lit("unknown")}
    return df.select(ident.alias("id"), split_signs(F.array_join(signs, " ")).alias("signs"), *[c.alias(n) for n, c in (default | given).items()])


def object_type(description: Column) -> Column:
    """A record's kind by words in its description; "sealing" counts as a seal, since it holds that word."""
    d = F.lower(description)
    return F.when(d.contains("seal"), "seal").when(d.contains("tablet"), "tablet").when(d.contains("pot") | d.contains("jar"), "pottery").otherwise("unknown")


def described_motif(description: Column) -> Column:
    """The description's words joined by ``_``, without a last word that names the object."""
    words = F.filter(F.split(description, r"(?U)\s+"), lambda w: w != "")
    named = (F.size(words) >= 2) & F.lower(F.element_at(words, -1)).isin("seal", "tablet", "sealing")
    return or_unknown(F.array_join(F.when(named, F.slice(words, 1, F.size(words) - 1)).otherwise(words), "_"))


def read_grapheme_json(spark: SparkSession, path: str, granularity: str = "primary", min_count: int = 3) -> DataFrame:
    """JSON arrays of ``{id, description, graphemes: [{id, features: [damage, line, uncertainty, allograph...]}]}``.

    A sign is the grapheme's id (``primary``), with its allograph features (``allograph``), or with them only where
    the whole corpus has that sign ``min_count`` times (``hierarchical``: one count and join of the exploded signs).
    """
    if granularity not in ("primary", "allograph", "hierarchical"):
        raise ValueError(f"unknown granularity: {granularity}")
    schema = "id string, description string, graphemes array<struct<id: string, features: array<string>>>"
    sides = spark.read.schema(schema).option("multiLine", True).json(path).where(F.size("graphemes") > 0)

    def full(g: Column) -> Column:
        extra = F.transform(F.slice(g["features"], 4, F.greatest(F.size(g["features"]) - 3, F.lit(0))), lambda f: F.coalesce(f, F.lit("None")))
        return F.when(F.size(g["features"]) > 3, F.concat_ws("_", g["id"], F.array_join(extra, "-"))).otherwise(g["id"])

    if granularity == "hierarchical":
        key = ["id", "description", "graphemes"]
        rows = sides.groupBy(key).agg(F.count("*").cast("int").alias("copies"))
        each = rows.select(*key, "copies", F.posexplode("graphemes").alias("pos", "g")).select(*key, "copies", "pos", F.col("g.id").alias("plain"), full(F.col("g")).alias("full"))
        common = each.groupBy("full").agg(F.sum("copies").alias("n")).where(F.col("n") >= min_count).select("full", F.lit(True).alias("common"))
        named = each.join(common, "full", "left").withColumn("sign", F.when(F.col("common"), F.col("full")).otherwise(F.col("plain")))
        back = named.groupBy(*key, "copies").agg(F.array_sort(F.collect_list(F.struct("pos", "sign"))).alias("signs"))
        sides = back.withColumn("signs", F.col("signs.sign")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    else:
        sides = sides.withColumn("signs", F.transform("graphemes", lambda g: full(g) if granularity == "allograph" else g["id"]))

    def feature(i: int) -> Column:
        return F.transform(F.filter("graphemes", lambda g: F.size(g["features"]) > i), lambda g: g["features"][i])

    unsure = F.transform(feature(2), lambda u: u.try_cast("double"))
    mean = F.aggregate(unsure, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) / F.size(unsure)
    return _record(
        sides, F.col("id"), F.col("signs"),
        site=F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in SITES.items() for x in pair]), F.substring("id", 1, 1)), F.lit("unknown")),
        object_type=object_type(F.col("description")),
        line_count=F.coalesce(F.array_max(F.transform(feature(1), lambda x: x.try_cast("int"))), F.lit(1)),
        damaged=F.exists(feature(0), lambda d: d.isNotNull() & F.coalesce(d.try_cast("double") != 0, F.lit(True))),
        reading_direction=F.lit("L-R"), motif=described_motif(F.col("description")),
        mean_uncertainty=F.when(F.size(unsure) > 0, F.bround(mean, 2)).otherwise(0.0),
    )


def sql_rows(dump: DataFrame, name: str, n_fields: int) -> DataFrame:
    """``f`` (array of text) of each tuple with ``n_fields`` fields in the statements that insert into a table, and ``at``, an order.

    ``dump``: ``statement`` and ``at``. Fields are parted by commas outside double quotes.
    """
    head = rf"^\s*{name}\s*\("
    tuples = dump.where(F.col("statement").rlike(head)).select("at", F.posexplode(F.regexp_extract_all(F.regexp_replace("statement", head, ""), F.lit(r"\(([^()]*)\)"), 1)).alias("k", "t"))
    fields = F.transform(F.split("t", r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda x: F.regexp_replace(_stripped(x), r'^"+|"+$', ""))
    return tuples.select(F.struct("at", "k").alias("at"), fields.alias("f")).where(F.size("f") == n_fields)


def read_sql_dump(spark: SparkSession, path: str) -> DataFrame:
    """A dump with SITE, SEAL, INSCRIPTION, ICONOGRAPHY and GLYPHSEQUENCE inserts: glyphs by index, four left joins.

    Of repeated keys the last row counts. All insert statements of a table are read. A seal without a site name keeps
    its code; a missing inscription row means whole and ``R/L``. Rows whose index is no integer are dropped.
    """
    place = F.struct(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("row"))
    dump = spark.read.text(path, lineSep="INSERT INTO").select(F.col("value").alias("statement"), place.alias("at"))

    def last(of: str, n_fields: int, **fields: int) -> DataFrame:
        rows = sql_rows(dump, of, n_fields).select(F.col("f")[0].alias("key"), F.struct(*[F.col("f")[i].alias(n) for n, i in fields.items()]).alias("v"), "at")
        return rows.groupBy("key").agg(F.max_by("v", "at").alias("v")).select("key", "v.*")

    sites = last("SITE", 2, name=1).withColumnRenamed("key", "code")
    seals = last("SEAL", 8, code=1, number=3)
    named = seals.join(sites, "code", "left").select("key", F.coalesce("name", "code").alias("site"), F.when(F.upper("number") != "NULL", F.col("number")).alias("number"))
    glyphs = sql_rows(dump, "GLYPHSEQUENCE", 3).select(F.col("f")[0].alias("key"), F.struct(F.col("f")[2].try_cast("int").alias("idx"), "at", F.concat(F.lit("G"), F.col("f")[1]).alias("sign")).alias("g")).where("g.idx is not null")
    rows = glyphs.groupBy("key").agg(F.array_sort(F.collect_list("g")).alias("g"))
    rows = rows.join(named, "key", "left").join(last("INSCRIPTION", 3, whole=1, direction=2), "key", "left").join(last("ICONOGRAPHY", 2, drawn=1), "key", "left")
    return _record(
        rows, F.concat(F.lit("S"), F.col("key")), F.col("g.sign"), site=or_unknown(F.col("site")), damaged=F.coalesce(F.col("whole") == "N", F.lit(False)),
        reading_direction=F.when(F.col("direction") == "L/R", "R-L").otherwise("L-R"), motif=or_unknown(F.col("drawn")), cisi_number=or_unknown(F.col("number")),
    )


def read_positioned_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of ``{textnum, sideline, posnum, S1..S14}``: the first ``posnum`` signs, stars counted and dropped, zero padding removed."""
    slots = [f"S{i}" for i in range(1, 15)]
    raw = spark.read.schema(", ".join(f"{c} string" for c in ("textnum", "sideline", "posnum", *slots))).option("multiLine", True).json(path)
    taken = F.filter(F.slice(F.array(*slots), 1, F.coalesce(F.greatest(F.col("posnum").try_cast("int"), F.lit(0)), F.lit(0))), lambda s: s != "")
    rows = raw.withColumn("taken", taken).where(F.size("taken") > 0)

    def sign(s: Column) -> Column:
        bare = F.ltrim(s, F.lit("*"))
        return F.concat(F.lit("MSg"), F.coalesce(bare.try_cast("int").cast("string"), bare))

    starred = F.size(F.filter("taken", lambda s: s.startswith("*")))
    return _record(rows, F.concat_ws(".", F.coalesce("textnum", F.lit("unknown")), F.coalesce("sideline", F.lit("0"))), F.transform("taken", sign), mean_uncertainty=F.bround(100.0 * starred / F.size("taken"), 2))


def read_marked_lines(spark: SparkSession, path: str, granularity: str = "lemma", min_tokens: int = 2) -> DataFrame:
    """Marked-up compositions: of each ``<l n=..>`` the ``lemma`` (or ``form``) of its ``<w>``, illegible ones left out; all lines are numbered.

    Files are split at the ends of lines. A line without an end at the end of its file counts as one.
    """
    attribute = "lemma" if granularity == "lemma" else "form"
    parts = records.read(spark, path, "</l>")
    named = parts.withColumn("work", F.regexp_extract("value", r'<TEI\.2\s+id="([^"]*)"', 1)).where("work <> ''")
    works = named.groupBy("file_").agg(F.min_by("work", F.struct("split_", "row_")).alias("work"))
    lines = parts.where(F.col("value").rlike(r'<l\s+n="[^"]*"[^>]*>')).withColumn("line", F.regexp_extract("value", r'(?s)<l\s+n="[^"]*"[^>]*>(.*)$', 1)).drop("value")
    words = F.filter(F.regexp_extract_all("line", F.lit(rf'<w\s[^>]*\b{attribute}="([^"]*)"[^>]*>'), 1), lambda t: ~t.isin(*ILLEGIBLE))
    rows = records.counted(lines, "i").withColumn("words", words).where(F.size("words") >= min_tokens).join(works, "file_", "left").withColumn("work", F.coalesce("work", F.lit("unknown")))
    return _record(rows, F.concat(F.col("work"), F.lit(".L"), (F.col("i") + 1).cast("string")), F.col("words"), site=F.col("work"), object_type=F.lit("literary_line"))


def read_conllu(spark: SparkSession, path: str, min_tokens: int = 2) -> DataFrame:
    """CoNLL-U files: the lemmas of each sentence; numbers count sentences with a lemma. Files named ``*_parsed`` are left out.

    Files are read line by line in splits; the blank lines before a line name its sentence.
    """
    lines = records.read(spark, path).where(~F.col("file_").endswith("_parsed"))
    fields = F.split("value", "\t")
    counts = records.counted(lines, "sentence", what=~F.col("value").rlike(r"(?U)\S")).withColumn("f", fields)
    good = ~F.col("value").startswith("#") & (F.size("f") >= 3) & ~F.get("f", F.lit(0)).rlike("[-.]") & ~F.get("f", F.lit(2)).isin("", "_")
    tokens = counts.where(good).select(*records.PLACE, "sentence", F.col("f")[2].alias("lemma"))
    order = F.struct("split_", "row_")
    sentences = tokens.groupBy("file_", "sentence").agg(F.min(order).alias("first_"), F.array_sort(F.collect_list(F.struct("split_", "row_", "lemma"))).alias("t"))
    numbered = records.counted(sentences.select("file_", "first_.*", F.col("t.lemma").alias("words")), "i").where(F.size("words") >= min_tokens)
    work = F.regexp_replace(F.url_decode(F.element_at(F.split("file_", "/"), -1)), r"\.conllu", "")
    rows = numbered.withColumn("work", work)
    return _record(rows, F.concat(F.col("work"), F.lit(".S"), (F.col("i") + 1).cast("string")), F.col("words"), site=F.col("work"), object_type=F.lit("literary_sentence"))


def read_poems(spark: SparkSession, path: str, min_tokens: int = 2) -> DataFrame:
    """A CSV of ``id, tamil_text, thinai, work``: each line's words without punctuation at their edges and without numbers of up to three digits."""
    poems = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    get = lambda n: F.col(n) if n in poems.columns else F.lit(None).cast("string")
    lines = poems.select(get("id").alias("poem"), or_unknown(get("thinai")).alias("theme"), or_unknown(get("work")).alias("work"), F.posexplode(F.split("tamil_text", "\n")).alias("i", "line"))
    bare = F.transform(F.split(_stripped(F.col("line")), r"(?U)\s+"), lambda t: _stripped(F.regexp_replace(t, f"^{EDGE}|{EDGE}$", "")))
    rows = lines.withColumn("words", F.filter(bare, lambda t: (t != "") & ~t.rlike(r"(?U)^\d{1,3}$"))).where(F.size("words") >= min_tokens)
    return _record(rows, F.concat(F.col("poem"), F.lit(".L"), (F.col("i") + 1).cast("string")), F.col("words"), site=F.col("work"), object_type=F.lit("literary_line"), motif=F.col("theme"))
