"""Minimal pairs, the substitution graph, its communities and their stability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signflow.functions.portable import global_rank, hashed
from signflow.operators.communities import communities
from signflow.operators.graph import components
from signflow.operators.tokens import tokens
from signflow.session import discard, materialize


def _holes() -> Column:
    """Each place of a row: position, sign, and the signs before and after."""
    n = F.size("signs")
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct((i - 1).alias("position"), F.element_at("signs", i).alias("sign"), F.slice("signs", F.lit(1), i - 1).alias("before"), F.slice("signs", i + 1, n - i).alias("after")))


def in_runs(corpus: DataFrame, chunk: int = 400, *keys: str) -> DataFrame:
    """The rows with ``len`` and ``chunk``, the number of their run of so many of their length, by id."""
    ranked = global_rank(corpus.where(F.size("signs") > 0).withColumn("len", F.size("signs")), *keys, "len", "id")
    first = ranked.groupBy(*keys, "len").agg(F.min("rank").alias("first_"))  # one row for each length
    return ranked.join(F.broadcast(first), [*keys, "len"]).withColumn("chunk", F.floor((F.col("rank") - F.col("first_")) / chunk)).drop("rank", "first_")


def minimal_pairs(corpus: DataFrame, chunk: int | None = 400, *keys: str, same: tuple[str, ...] = ()) -> DataFrame:
    """Rows of one length that differ in exactly one place, as an equi-join on everything but that place.

    ``chunk``: only rows in the same run of so many of their length, by id, are compared; None compares all.
    ``same``: columns in which the rows of a pair agree, joined on. The join key is short (a hash beside the length
    and the place); prefix and suffix confirm it. For numbers of pairs take ``pair_counts``, which forms none.
    """
    c = in_runs(corpus, chunk, *keys) if chunk else corpus.where(F.size("signs") > 0).withColumns({"len": F.size("signs"), "chunk": F.lit(0).cast("bigint")})
    k = c.select(*keys, *[F.col(x).alias(f"{x}_same") for x in same], "id", "site", "object_type", "motif", "len", "chunk", F.inline(_holes())).withColumn("key", F.xxhash64("before", "after"))
    by = [*keys, *[f"{x}_same" for x in same], "len", "chunk", "position", "key"]
    a, b = k.select(*by, *[F.col(x).alias(f"{x}_a") for x in ("id", "sign", "before", "after", "site", "object_type", "motif")]), k.select(*by, *[F.col(x).alias(f"{x}_b") for x in ("id", "sign", "before", "after", "site", "object_type", "motif")])
    joined = a.join(b, by).where("id_a < id_b and sign_a <> sign_b and before_a = before_b and after_a = after_b")
    context = (F.col("site_a") == F.col("site_b")) & (F.col("object_type_a") == F.col("object_type_b")) & (F.col("site_a") != "unknown")
    motif = context & (F.col("motif_a") == F.col("motif_b")) & (F.col("motif_a") != "unknown")
    return joined.select(*keys, "id_a", "id_b", "len", "position", "sign_a", "sign_b", "site_a", "motif_a", context.alias("context"), motif.alias("same_motif"))


def _in_tier(corpus: DataFrame, name: str) -> tuple[DataFrame, list[str]]:
    """The rows that may pair in a tier, and the columns in which its pairs agree."""
    same = {"all": [], "context": ["site", "object_type"], "motif": ["site", "object_type", "motif"]}[name]
    for x in same:
        corpus = corpus.where(F.col(x).isNotNull() if x == "object_type" else F.col(x) != "unknown")
    return corpus.where(F.size("signs") > 0), same


def _surrounded(rows: DataFrame, own: list[str], *values: str) -> DataFrame:
    """around (``own``, length, position and the signs on both sides, after their hash), sign and ``values`` of each place of ``rows``.

    The signs around are one text, each after its length (``~`` for a null): as exact as their arrays, in half the bytes.
    """
    by, n = [*own, "len", "position", "rest"], F.size("signs")
    told = F.transform("signs", lambda x: F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("~")))
    places = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct((i - 1).alias("position"), F.element_at("signs", i).alias("sign"), F.concat(F.array_join(F.slice("told_", F.lit(1), i - 1), ""), F.array_join(F.slice("told_", i + 1, n - i), "")).alias("rest")))
    holes = rows.withColumn("told_", told).select(*own, *values, n.alias("len"), F.inline(places))
    return holes.select(F.struct(F.xxhash64(*by).alias("key"), *by).alias("around"), "sign", *values)


def _beside(holes: DataFrame, *values: str) -> DataFrame:
    """The places with one surrounding and two signs, sign_a < sign_b. Both sides are one shuffle of the places."""
    a, b = (holes.select("around", *[F.col(x).alias(f"{x}_{side}") for x in ("sign", *values)]) for side in "ab")
    return a.join(b, "around").where("sign_a < sign_b")


def pair_counts(corpus: DataFrame, name: str = "all", *keys: str, within: tuple[str, ...] = ()) -> DataFrame:
    """keys, len, position, sign_a < sign_b, n: the number of all minimal pairs of a tier (of rows that agree in ``within``), whatever their ids.

    Equal rows are counted first, once for all their places; then what surrounds a place is met by itself, and counts
    are multiplied: the pairs themselves are never formed, so that a surrounding shared by many rows (as of rows of one
    sign) costs its distinct signs only.
    """
    rows, same = _in_tier(corpus, name)
    own = list(dict.fromkeys([*keys, *within, *same]))
    for x in (*keys, *within):
        rows = rows.where(F.col(x).isNotNull())
    holes = _surrounded(rows.groupBy(*own, "signs").agg(F.count("*").alias("n")), own, "n")
    return _beside(holes, "n").groupBy(*[F.col(f"around.{x}").alias(x) for x in (*keys, "len", "position")], "sign_a", "sign_b").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("n"))


def tier_counts(corpus: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """tier, len, position, sign_a < sign_b, n: ``pair_counts`` of all, context and motif pairs (of rows that agree in ``within``) at once.

    Places travel once, dealt by what surrounds them. A task sorts them once, leaves out those that no other sign stands
    beside in a tier, adds up the others and puts the distinct signs of a surrounding side by side.
    """
    rows = corpus.where(F.size("signs") > 0)
    for x in within:
        rows = rows.where(F.col(x).isNotNull())
    same = ["site", "object_type", "motif"]
    rows = rows.groupBy(*within, *same, "signs").agg(F.count("*").alias("n"))
    holes = _surrounded(rows, list(within), *same, "n").where(F.col("sign").isNotNull()).repartition("around")
    for k, name in ((3, "motif"), (2, "context"), (0, "all")):  # the finest first: its order serves the others
        own = Window.partitionBy("around", *same[:k])
        holes = holes.withColumn(f"{name}_", F.min("sign").over(own) < F.max("sign").over(own))
    context = (F.col("site") != "unknown") & F.col("object_type").isNotNull()
    of = lambda name, *own: F.struct(F.lit(name).alias("tier"), *[(F.col(x) if x in own else F.lit(None).cast("string")).alias(f"{x}_of") for x in same])
    tiers = F.array_compact(F.array(F.when(F.col("all_"), of("all")), F.when(F.col("context_") & context, of("context", *same[:2])), F.when(F.col("motif_") & context & (F.col("motif") != "unknown"), of("motif", *same))))
    by = ["around", "tier", *[f"{x}_of" for x in same]]
    met = holes.where("all_").select("around", "sign", "n", F.inline(tiers)).groupBy(*by, "sign").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.collect_list(F.struct("sign", "n")).alias("x"))
    met = met.where(F.size("x") > 1).select("tier", "around.len", "around.position", F.array_sort("x").alias("x"))
    one = met.select("tier", "len", "position", "x", F.posexplode("x").alias("i", "a"))  # a row for each sign, then for each after it: no list of pairs is held
    both = one.select("tier", "len", "position", "a", F.explode(F.slice("x", F.col("i") + 2, F.size("x") - F.col("i") - 1)).alias("b"))
    return both.groupBy("tier", "len", "position", F.col("a.sign").alias("sign_a"), F.col("b.sign").alias("sign_b")).agg(F.sum(F.col("a.n") * F.col("b.n")).alias("n"))


def pair_trials(corpus: DataFrame, trials: int, name: str = "all") -> DataFrame:
    """trial, u < v: in which trials a tier has a minimal pair of two signs, all trials from one mining.

    ``corpus`` has the bitmap ``trials`` of the trials that a row is in (see ``resampling.with_trials``). The bitmaps of
    equal rows are joined by or, those of two signs in one surrounding by and: a trial with a row of each has the pair.
    """
    rows, same = _in_tier(corpus, name)
    words = [f"w{i}" for i in range(-(-trials // 64))]
    held = rows.groupBy(*same, "signs").agg(*[F.bit_or(F.get("trials", i)).alias(w) for i, w in enumerate(words)])
    both = _beside(_surrounded(held, same, *words), *words).select(F.col("sign_a").alias("u"), F.col("sign_b").alias("v"), *[F.col(f"{w}_a").bitwiseAND(F.col(f"{w}_b")).alias(w) for w in words])
    return both.groupBy("u", "v").agg(*[F.bit_or(w).alias(w) for w in words]).select("u", "v", F.explode(trials_of(F.array(*words), trials)).alias("trial"))


def trials_of(bitmap: Column, trials: int) -> Column:
    """The trials whose bits are set."""
    return F.filter(F.sequence(F.lit(0), F.lit(trials - 1)), lambda t: F.call_function("shiftright", F.get(bitmap, F.floor(t / 64).cast("int")), t % 64).bitwiseAND(F.lit(1)) == 1)


def stability_by_trial(corpus: DataFrame, whole: DataFrame, trials: int, name: str = "motif") -> DataFrame:
    """``stability`` of the classes of ``whole`` (sign, component) in the trials that the rows' bitmaps ``trials`` name: as ``stability_by_part`` with a trial for a part, from one mining."""
    edge_table, path = materialize(pair_trials(corpus, trials, name).withColumn("weight", F.lit(1)), "trial-edges")
    words = range(-(-trials // 64))
    seen = corpus.select(F.explode(F.array_distinct("signs")).alias("sign"), *[F.get("trials", i).alias(f"w{i}") for i in words]).groupBy("sign").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in words])
    vocab = seen.select("sign", F.explode(trials_of(F.array(*[f"w{i}" for i in words]), trials)).alias("trial"))
    out, _ = materialize(stability(whole, classes(edge_table, 1, "trial"), vocab, "trial"), "stability")
    discard(corpus.sparkSession, path)
    return out


def matched_size(here: DataFrame, sampled: DataFrame) -> DataFrame:
    """class, members, jaccard in the smaller corpus (``here``), that of samples as small of the larger one (``sampled``: mean, low, high, trials), and the call.

    ``explained``: the smaller corpus does as well as the worst sample, so that its size explains it; ``vacuous``: the
    worst sample has no overlap at all, which anything reaches. Both are null for a class without testable samples.
    """
    of = sampled.groupBy("class").agg(F.avg("jaccard").alias("mean"), F.min("jaccard").alias("low"), F.max("jaccard").alias("high"), F.count("*").alias("trials"))
    return here.select("class", "members", "jaccard").join(of, "class", "left").withColumns({"explained": F.col("jaccard") >= F.col("low"), "vacuous": F.col("low") == 0})


def _number(pairs: DataFrame) -> Column:
    """How many pairs a group has, of pairs or of their counts."""
    return F.sum("n") if "n" in pairs.columns else F.count("*")


def tier(pairs: DataFrame, name: str = "all") -> DataFrame:
    """The pairs of a tier: all, context or motif."""
    return pairs if name == "all" else pairs.where({"context": "context", "motif": "same_motif"}[name])


def _ends() -> tuple[Column, Column]:
    return F.least("sign_a", "sign_b").alias("u"), F.greatest("sign_a", "sign_b").alias("v")


def edges(pairs: DataFrame, *keys: str) -> DataFrame:
    """u < v, weight, positions (sorted, distinct), of pairs or of their counts."""
    return pairs.groupBy(*keys, *_ends()).agg(_number(pairs).alias("weight"), F.array_sort(F.collect_set("position")).alias("positions"))


def distinct_contexts(pairs: DataFrame) -> DataFrame:
    """u, v, distinct (site, motif) of the pairs' first rows."""
    return pairs.groupBy(*_ends()).agg(F.count_distinct("site_a", "motif_a").alias("distinct_contexts"))


def distinct_contexts_whole(corpus: DataFrame) -> DataFrame:
    """``distinct_contexts`` of all minimal pairs, none of them formed: a (site, motif) counts if its first row with the one sign is before the last row with the other."""
    by = ["len", "position", "before", "after"]
    holes = corpus.where(F.size("signs") > 0).select("id", "site", "motif", F.size("signs").alias("len"), F.inline(_holes()))
    first = holes.groupBy(*by, "sign", "site", "motif").agg(F.min("id").alias("first")).withColumn("key", F.xxhash64(*by))
    last = holes.groupBy(*by, "sign").agg(F.max("id").alias("last")).select(F.xxhash64(*by).alias("key"), *[F.col(x).alias(f"{x}_b") for x in (*by, "sign")], "last")
    match = reduce(lambda x, y: x & y, [F.col(x) == F.col(f"{x}_b") for x in by], (F.col("sign") != F.col("sign_b")) & (F.col("first") < F.col("last")))
    pairs = first.join(last, "key").where(match).select(F.col("sign").alias("sign_a"), "sign_b", F.col("site").alias("site_a"), F.col("motif").alias("motif_a"))
    return distinct_contexts(pairs)


def classes(edge_table: DataFrame, least: int = 1, *keys: str) -> DataFrame:
    """keys, sign, component (its smallest sign) of the components of at least two signs; ``keys`` are graphs to keep apart."""
    kept, path = materialize(edge_table.where(F.col("weight") >= least).select(*keys, "u", "v"), "edges")  # read twice, mined once
    names = kept.select(*keys, F.explode(F.array("u", "v")).alias("sign")).distinct().withColumn("node", F.xxhash64(*keys, "sign"))
    found = components(kept.select(F.xxhash64(*keys, "u").alias("a"), F.xxhash64(*keys, "v").alias("b")))
    named = names.join(found, "node")
    out, _ = materialize(named.join(named.groupBy("component").agg(F.min("sign").alias("name")), "component").select(*keys, "sign", F.col("name").alias("component")), "classes")
    discard(edge_table.sparkSession, path)
    return out


def class_places(pairs: DataFrame, members: DataFrame, min_length: int = 3) -> DataFrame:
    """component, position, n: of the pairs within each class of ``members`` (sign, component), from rows of at least ``min_length`` signs, how many differ where."""
    end = lambda side: members.select(F.col("sign").alias(f"sign_{side}"), F.col("component").alias(f"component_{side}"))
    counted = pairs.where(F.col("len") >= min_length).groupBy("sign_a", "sign_b", "position").agg(_number(pairs).alias("n"))  # by sign before the joins
    inside = counted.join(end("a"), "sign_a").join(end("b"), "sign_b").where("component_a = component_b")
    return inside.groupBy(F.col("component_a").alias("component"), "position").agg(F.sum("n").alias("n"))


def class_positions(pairs: DataFrame, members: DataFrame, slots: DataFrame, min_length: int = 3) -> DataFrame:
    """Where the classes of ``members`` (sign, component) stand: one row for each class.

    Shares of first and last places are of each member's own total (``slots``: sign, n, n_initial, n_final), given as
    mean and population deviation over the members, null for under two. Of the pairs within the class, from rows of at
    least ``min_length`` signs: their number, commonest position (the smaller of a tie) and its share. A class is
    slot-like if that share is over 0.6 of five pairs or more and the last-place deviation is under 0.15.
    """
    final, initial = F.col("n_final") / F.col("n"), F.col("n_initial") / F.col("n")
    several = lambda c: F.when(F.count("*") > 1, c)
    profile = members.join(slots, "sign").groupBy("component").agg(F.count("*").alias("members"), several(F.avg(final)).alias("mean_final"), several(F.stddev_pop(final)).alias("std_final"), several(F.avg(initial)).alias("mean_initial"), several(F.stddev_pop(initial)).alias("std_initial"))
    places = class_places(pairs, members, min_length)
    most = places.groupBy("component").agg(F.sum("n").alias("n_pairs"), F.max_by("position", F.struct("n", -F.col("position"))).alias("top_position"), F.max("n").alias("top"))
    out = profile.join(most, "component", "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0))).withColumn("top_share", F.col("top") / F.col("n_pairs"))
    slot = F.coalesce((F.col("top_share") > 0.6) & (F.col("n_pairs") >= 5) & (F.col("std_final") < 0.15), F.lit(False))
    return out.drop("top").withColumn("slot_like", slot)


def degree_centrality(edge_table: DataFrame) -> DataFrame:
    """sign, degree, centrality = degree / (signs - 1)."""
    d = edge_table.select(F.explode(F.array("u", "v")).alias("sign")).groupBy("sign").agg(F.count("*").alias("degree"))
    n = d.agg(F.count("*").alias("signs"))
    return d.join(F.broadcast(n)).select("sign", "degree", (F.col("degree") / F.greatest(F.col("signs") - 1, F.lit(1))).alias("centrality"))


def stability(whole: DataFrame, parts: DataFrame, vocab: DataFrame, *keys: str) -> DataFrame:
    """For each class of ``whole`` and each part: members present, and the best Jaccard with a class of that part.

    ``whole``, ``parts`` (with keys): sign, component. ``vocab``: keys, sign.
    """
    here = whole.withColumnRenamed("component", "class").join(vocab.select(*keys, "sign").distinct(), "sign")
    sizes = here.groupBy(*keys, "class").agg(F.count("*").alias("members")).where("members > 1")
    part_sizes = parts.groupBy(*keys, "component").agg(F.count("*").alias("part_size"))
    both = here.join(parts, [*keys, "sign"]).groupBy(*keys, "class", "component").agg(F.count("*").alias("common"))
    jaccard = both.join(part_sizes, [*keys, "component"]).join(sizes, [*keys, "class"]).withColumn("jaccard", F.col("common") / (F.col("members") + F.col("part_size") - F.col("common")))
    best = jaccard.groupBy(*keys, "class").agg(F.max("jaccard").alias("jaccard"))
    return sizes.join(best, [*keys, "class"], "left").fillna(0.0, ["jaccard"])


def stability_by_part(corpus: DataFrame, whole: DataFrame, key: str, name: str = "motif", pairs: DataFrame | None = None) -> DataFrame:
    """``stability`` of the classes of ``whole`` in the parts of the corpus that the column ``key`` names (sites, trials): the components of each part's own pairs, mined anew or given as ``pair_counts`` by ``key``."""
    own = edges(pair_counts(corpus, name, key) if pairs is None else pairs, key)
    return stability(whole, classes(own, 1, key), tokens(corpus, key), key)


def modularity_classes(edge_table: DataFrame, *keys: str) -> DataFrame:
    """keys, sign, community (its smallest sign) of the modularity communities of at least two signs; ``keys`` are graphs to keep apart."""
    edge_table, path = materialize(edge_table.select(*keys, "u", "v", "weight"), "edges")  # read twice, mined once
    names = edge_table.select(*keys, F.explode(F.array("u", "v")).alias("sign")).distinct().withColumn("node", F.xxhash64(*keys, "sign"))
    graph = F.xxhash64(F.lit("graph"), *keys)
    found = communities(edge_table.select(graph.alias("graph"), F.xxhash64(*keys, "u").alias("a"), F.xxhash64(*keys, "v").alias("b"), "weight"))
    named = names.join(found, "node")
    sizes = named.groupBy("community").agg(F.min("sign").alias("name"), F.count("*").alias("size")).where("size > 1")
    out, _ = materialize(named.join(sizes, "community").select(*keys, "sign", F.col("name").alias("community")), "classes")
    discard(edge_table.sparkSession, path)
    return out


def summaries(pairs: DataFrame, members: DataFrame, examples: int = 5) -> DataFrame:
    """component, size, signs (sorted) and the first ``examples`` pairs within each class of ``members``, in order of ids and position."""
    sizes = members.groupBy("component").agg(F.count("*").alias("size"), F.array_sort(F.collect_set("sign")).alias("signs"))
    inside = pairs.join(members.select(F.col("sign").alias("sign_a"), "component"), "sign_a")
    order = Window.partitionBy("component").orderBy("id_a", "id_b", "position")
    few = inside.withColumn("rank_", F.row_number().over(order)).where(F.col("rank_") <= examples)
    told = few.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank_", "sign_a", "sign_b"))), lambda x: F.concat(x["sign_a"], F.lit(">"), x["sign_b"])).alias("examples"))
    return sizes.join(told, "component", "left")


def first_pairs(corpus: DataFrame, name: str = "motif", examples: int = 5) -> DataFrame:
    """id_a, id_b, position, sign_a, sign_b: of a tier's minimal pairs at least the first ``examples`` of each surrounding, in order of ids.

    Of equal rows, so many of the smallest ids are kept; of those in one surrounding, so many with the sign of its first
    row and so many with others. Any pair with another row comes after so many pairs of these (with that first row, or
    with the same partner), and no more than 2 x ``examples`` rows of a surrounding are put together.
    """
    rows, same = _in_tier(corpus, name)
    ranked = lambda df, by, order: df.withColumn("rank_", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank_") <= examples).drop("rank_")
    few = ranked(rows.select("id", *same, "signs"), [*same, "signs"], ["id"])
    holes = _surrounded(few, same, "id")
    lead = F.first("sign").over(Window.partitionBy("around").orderBy("id", "sign"))
    kept = ranked(holes.withColumn("leads_", F.col("sign") == lead), ["around", "leads_"], ["id", "sign"])
    met = kept.groupBy("around").agg(F.array_sort(F.collect_list(F.struct("id", "sign"))).alias("rows_")).where(F.size("rows_") > 1)
    x = F.col("rows_")
    both = F.flatten(F.transform(x, lambda a, i: F.transform(F.filter(F.slice(x, i + 2, F.lit(2 * examples)), lambda b: (b["sign"] != a["sign"]) & (b["id"] > a["id"])), lambda b: F.struct(a["id"].alias("id_a"), b["id"].alias("id_b"), a["sign"].alias("sign_a"), b["sign"].alias("sign_b")))))
    return met.select(F.col("around.position").alias("position"), F.inline(both))


def mean_similarity(members: DataFrame, vectors: DataFrame, *keys: str) -> DataFrame:
    """keys, members, similarity: the mean cosine over all pairs of a group's signs, null for under two.

    No pair is formed: of unit vectors, the squared length of the sum is the members' number and twice all cosines.
    ``members``: keys, sign. ``vectors``: sign, vector (zero ones count as no similarity).
    """
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    unit = vectors.withColumn("norm_", norm).select("sign", (F.col("norm_") > 0).cast("int").alias("solid_"), F.when(F.col("norm_") > 0, F.transform("vector", lambda x: x / F.col("norm_"))).otherwise(F.col("vector")).alias("unit_"))
    own = members.join(unit, "sign")
    sizes = own.groupBy(*keys).agg(F.count("*").alias("members"), F.sum("solid_").alias("solid_"))
    sums = own.select(*keys, F.posexplode("unit_").alias("at_", "x_")).groupBy(*keys, "at_").agg(F.sum("x_").alias("x_")).groupBy(*keys).agg(F.sum(F.col("x_") * F.col("x_")).alias("length_"))
    k = F.col("members")
    return sizes.join(sums, list(keys)).select(*keys, "members", F.when(k > 1, (F.col("length_") - F.col("solid_")) / (k * (k - 1))).alias("similarity"))


def corroborated(members: DataFrame, vectors: DataFrame, draws: int = 200, seed: int = 0) -> DataFrame:
    """component, members, similarity, baseline and whether the class is more alike than that: the mean of ``draws`` sets of as many signs.

    Sets are drawn without replacement: a draw puts all signs of ``vectors`` in hashed order, and a class of k members
    is held against its first k; a class of all signs is no more alike than that. ``members``: sign, component; those
    without a vector don't count.
    """
    own, path = materialize(mean_similarity(members, vectors, "component").where("members > 1"), "similarity")
    sizes = own.select("members").distinct()
    most = sizes.agg(F.max("members")).first()[0] or 0
    order = F.row_number().over(Window.partitionBy("draw").orderBy("order_", "sign"))  # a vocabulary
    lines = vectors.select("sign", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn("order_", hashed(seed, F.col("draw"), F.col("sign"))).withColumn("place", order).where(F.col("place") <= most)
    sets = lines.join(F.broadcast(sizes.withColumnRenamed("members", "k")), F.col("place") <= F.col("k")).select("k", "draw", "sign")  # as many sizes as classes at most
    alike = mean_similarity(sets, vectors, "k", "draw")
    baseline = alike.groupBy(F.col("k").alias("members")).agg(F.avg("similarity").alias("baseline"))
    out, _ = materialize(own.join(baseline, "members", "left").select("component", "members", "similarity", "baseline", (F.col("similarity") > F.col("baseline") + 1e-9).alias("corroborated")), "corroborated")
    discard(members.sparkSession, path)
    return out
