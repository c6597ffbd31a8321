"""Corpora: a row for each record with an ordered array of signs and a few attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from signflow.sources import records

#: The persisted columns, all text in files. Reserved signs are pads and marks that models add.
FIELDS = ("inscription_id", "sign_sequence", "site", "object_type", "line_count", "damaged", "reading_direction", "motif", "mean_uncertainty", "cisi_number")
RESERVED = ("<S>", "<END>", "<PAD>", "<MASK>")


def split_signs(text: Column) -> Column:
    """White-space parted signs (Unicode white space), without reserved ones."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda s: (s != "") & ~s.isin(*RESERVED))


def or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))


def typed(raw: DataFrame, *more: str) -> DataFrame:
    """Text columns to the corpus schema, with a default for each missing column or value; the columns ``more`` stay."""
    get = lambda n: F.col(n) if n in raw.columns else F.lit(None).cast("string")
    number = F.col("ord") if "ord" in raw.columns else F.monotonically_increasing_id()
    return raw.select(
        *more, F.coalesce(get("inscription_id"), F.concat(F.lit("row"), number.cast("string"))).alias("id"),
        split_signs(get("sign_sequence")).alias("signs"), or_unknown(get("site")).alias("site"), or_unknown(get("object_type")).alias("object_type"),
        F.coalesce(F.expr("try_cast(line_count as int)") if "line_count" in raw.columns else F.lit(None), F.lit(1)).alias("line_count"),
        F.coalesce(F.lower(F.trim(get("damaged"))).isin("1", "true", "yes"), F.lit(False)).alias("damaged"),
        F.coalesce(F.nullif(get("reading_direction"), F.lit("")), F.lit("R-L")).alias("reading_direction"), or_unknown(get("motif")).alias("motif"),
        F.coalesce(F.expr("try_cast(mean_uncertainty as double)") if "mean_uncertainty" in raw.columns else F.lit(None), F.lit(0.0)).alias("mean_uncertainty"),
        or_unknown(get("cisi_number")).alias("cisi_number"),
    )


def read_csv(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """A corpus CSV: columns go by the header, optional ones may be missing.

    ``ordered`` adds ``ord``, the record's number (from 0) in the order of files and lines; where ids are missing they
    are ``row`` and that number. Files are read in splits.
    """
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    if ordered or "inscription_id" not in raw.columns:
        raw = records.counted(records.placed(raw), "ord", by_file=False)
    return typed(raw, *(["ord"] if ordered else []))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records; ``sign_sequence`` may be a list or text."""
    schema = StructType([StructField(f, StringType()) for f in FIELDS])
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    listed = F.from_json("sign_sequence", "array<string>")
    return typed(raw.withColumn("sign_sequence", F.when(F.col("sign_sequence").startswith("["), F.array_join(listed, " ")).otherwise(F.col("sign_sequence"))))


#: Columns of the forms that converters write: without the number of a catalogue, or with it in place of the uncertainty.
FORMS = {"full": FIELDS, "plain": FIELDS[:9], "catalogued": (*FIELDS[:8], FIELDS[9])}


def write_csv(corpus: DataFrame, path: str, form: str = "full") -> None:
    """The persisted columns of a form (see FORMS), signs joined by spaces."""
    out = corpus.select(F.col("id").alias("inscription_id"), F.array_join("signs", " ").alias("sign_sequence"), *[F.col(c).cast("string") for c in FORMS[form][2:]])
    out.write.option("header", True).option("escape", '"').csv(path)


def normalized(corpus: DataFrame) -> DataFrame:
    """Signs in reading order: those of ``L-R`` rows reversed."""
    return corpus.withColumn("signs", F.when(F.col("reading_direction") == "L-R", F.reverse("signs")).otherwise(F.col("signs")))


def keep(corpus: DataFrame, exclude_damaged: bool = True, exclude_multiline: bool = False, min_len: int = 1) -> DataFrame:
    """Rows that are whole, on one line if asked, and long enough."""
    wanted = F.size("signs") >= min_len
    if exclude_damaged:
        wanted &= ~F.col("damaged")
    if exclude_multiline:
        wanted &= F.col("line_count") <= 1
    return corpus.where(wanted)


def of_site_and_motif(corpus: DataFrame, site: str, prefix: str) -> DataFrame:
    """The rows of a site whose motif begins with ``prefix``."""
    return corpus.where((F.col("site") == site) & F.col("motif").startswith(prefix))


def broad_motif(motif: Column) -> Column:
    """The motif's part before a colon."""
    return F.when(motif == "unknown", motif).otherwise(F.substring_index(motif, ":", 1))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records: their lines' part brands are the signs. One shuffle of lines by order, one by part; signs meet orders that have their people already, and stay where they were put together."""
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice")
    signs = lines.join(_read(spark, sf_dir, "part").select("p_partkey", "p_brand"), lines["l_partkey"] == F.col("p_partkey"))
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "p_brand")
    dealt = signs.select("l_orderkey", place.alias("place")).repartition("l_orderkey")  # as rows: an order's lines don't lie together, so lists made before the shuffle are of one line each
    rows = dealt.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("place")), lambda x: x["p_brand"]).alias("signs"))
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    people = _read(spark, sf_dir, "customer").join(_read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "c_mktsegment")
    joined = rows.join(orders.join(people, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("o_orderkey").alias("id"), "signs", F.col("n_name").alias("site"), F.col("o_orderpriority").alias("object_type"), F.lit(1).alias("line_count"), (F.col("o_orderstatus") == "P").alias("damaged"),
        F.when(F.col("o_orderkey") % 2 == 1, "L-R").otherwise("R-L").alias("reading_direction"), F.col("c_mktsegment").alias("motif"), F.lit(0.0).alias("mean_uncertainty"), F.lit("unknown").alias("cisi_number"),
    )


def lines_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines as records of white-space parted words; damaged if labelled toxic."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    labels = _read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.join(labels, "doc_id", "left").select(
        F.concat_ws(":", F.col("doc_id").cast("string"), F.col("line").cast("string")).alias("id"), split_signs(F.col("text")).alias("signs"), F.col("source").alias("site"), F.lit("line").alias("object_type"), F.lit(1).alias("line_count"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("damaged"), F.lit("R-L").alias("reading_direction"), F.col("lang").alias("motif"), F.lit(0.0).alias("mean_uncertainty"), F.lit("unknown").alias("cisi_number"),
    )


def events_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as records: their events in order of time."""
    place = F.struct("ts", "event_id", "event_type")
    rows = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["event_type"]).alias("signs"))
    return rows.select(
        F.col("user_id").alias("id"), "signs", F.lit("unknown").alias("site"), F.lit("session").alias("object_type"), F.lit(1).alias("line_count"), F.lit(False).alias("damaged"),
        F.lit("R-L").alias("reading_direction"), F.lit("unknown").alias("motif"), F.lit(0.0).alias("mean_uncertainty"), F.lit("unknown").alias("cisi_number"),
    )


def write_report(rows: DataFrame, path: str) -> None:
    """A report (few rows) as one JSON file of a line for each row."""
    rows.coalesce(1).write.mode("overwrite").json(path)
