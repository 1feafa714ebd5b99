"""Brands of offers: from features, by majority in the cluster, from titles; order and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .order import started
from ..functions.text import UNKNOWN, brand_value, clean_features, clean_title, clean_value, extract_brand, guess_brand, normalize_brand, numbers, strip, title_model_words, with_numeric_parts
from ..staging import small, stage

#: Known brands up to which they are one dictionary in an expression; more are matched by words, in a join.
MAX_BRANDS = 2_000


def majority(offers: DataFrame, brand: str = "brand") -> DataFrame:
    """cluster_id, top: the cluster's most frequent known brand, ties to the smaller; clusters without one are missing."""
    counts = offers.filter(F.col(brand) != UNKNOWN).groupBy("cluster_id", F.col(brand).alias("b")).agg(F.count("*").alias("n"))
    return counts.groupBy("cluster_id").agg(F.min(F.struct((-F.col("n")).alias("less"), F.col("b").alias("b"))).alias("m")).select("cluster_id", F.col("m.b").alias("top"))


def known_brands(tops: DataFrame) -> list[str] | None:
    """The distinct brands, sorted; None if they are more than MAX_BRANDS."""
    rows = tops.select("top").distinct().limit(MAX_BRANDS + 1).collect()
    return sorted(r["top"] for r in rows) if len(rows) <= MAX_BRANDS else None


def guesses(offers: DataFrame, brands: list[str]) -> DataFrame:
    """cluster_id, idx, g: the brand that a title names, or unknown."""
    return offers.select("cluster_id", "idx", normalize_brand(guess_brand(strip(F.col("title")), brands)).alias("g"))


def guesses_by_join(offers: DataFrame, tops: DataFrame) -> DataFrame:
    """guesses for any number of brands: a title's runs of words are joined with the brands; the leftmost counts, of those at a place the longest.

    A brand stands between word boundaries, so it begins and ends with whole words.
    """
    brands = tops.select(F.col("top").alias("b")).distinct()
    most = brands.agg(F.max(F.size(F.split("b", " ")))).first()[0] or 0
    title = strip(F.col("title"))
    words = F.split(F.lower(title), r"(?U)(?<=\w)(?=[^\w])|(?<=[^\w])(?=\w)")  # words and what stands between them, in turn
    runs = F.flatten(F.transform(words, lambda w, i: F.transform(F.sequence(F.lit(1), F.lit(2 * most)), lambda n: F.struct(i.alias("at"), (-n).alias("less"), F.array_join(F.slice(words, i + 1, n), "").alias("b")))))
    found = offers.select("cluster_id", "idx", F.explode(runs).alias("x")).select("cluster_id", "idx", "x.*").join(brands, "b")
    best = found.groupBy("cluster_id", "idx").agg(F.min(F.struct("at", "less", "b")).alias("x"))
    return best.select("cluster_id", "idx", normalize_brand(F.col("x.b")).alias("g"))


def fill_from_titles(offers: DataFrame, tops: DataFrame) -> DataFrame:
    """cluster_id, guess: the first title (by idx) that names a brand of tops (top)."""
    brands = known_brands(tops)
    g = guesses_by_join(offers, tops) if brands is None else guesses(offers, brands)
    return g.filter(F.col("g") != UNKNOWN).groupBy("cluster_id").agg(F.min_by("g", "idx").alias("guess"))


def cluster_brands(offers: DataFrame) -> DataFrame:
    """cluster_id (not null), n offers, brand of each cluster: its majority, else what its titles name, else unknown. Written, one row a cluster.

    Values of the brand feature are counted before they are normalised: a cluster has few.
    """
    values = offers.groupBy("cluster_id", brand_value(F.col("features")).alias("v")).agg(F.count("*").alias("n"))
    counts = values.select("cluster_id", F.coalesce(normalize_brand(F.col("v")), F.lit(UNKNOWN)).alias("b"), "n").groupBy("cluster_id", "b").agg(F.sum("n").alias("n"))
    known = F.when(F.col("b") != UNKNOWN, F.struct((-F.col("n")).alias("less"), F.col("b").alias("b")))
    found = stage(counts.groupBy("cluster_id").agg(F.sum("n").alias("n"), F.min(known)["b"].alias("top")), "clusters")
    branded = fill_tops(offers, found)
    return branded if found.filter("top is null").isEmpty() else stage(branded, "brands")


def fill_tops(offers: DataFrame, found: DataFrame) -> DataFrame:
    """Written found with brand in place of top: where it is null what the cluster's titles name, else unknown."""
    none = found.filter("top is null")
    rest = [c for c in found.columns if c != "top"]
    if none.isEmpty():
        return found.select(*rest, F.col("top").alias("brand"))
    guess = fill_from_titles(offers.join(none.select("cluster_id"), "cluster_id", "left_semi"), found.filter("top is not null").select("cluster_id", "top"))
    return found.join(guess, "cluster_id", "left").select(*rest, F.coalesce("top", "guess", F.lit(UNKNOWN)).alias("brand"))


def cluster_rows(offers: DataFrame, by: str = "cluster_id") -> DataFrame:
    """A row for each cluster (by names it, too), whose distinct texts are cleaned once: cluster_id, idx, title and values (places of the offers' title and feature
    values, from 1) in words (shingles of the cleaned titles) and numbers (of the cleaned values), brand (places of brand values) in brands (normalised, null if unknown).
    """
    features = F.coalesce("features", F.array().cast("array<struct<key:string,value:string>>")).alias("features")
    found = offers.groupBy(by).agg(F.first("cluster_id").alias("id"), F.collect_list(F.struct("idx", "title", features, brand_value(F.col("features")).alias("b"))).alias("o"))
    texts = found.select(F.col("id").alias("cluster_id"), "o", *[F.array_distinct(c).alias(n) for n, c in (("titles", F.col("o.title")), ("texts", F.flatten(F.transform("o", lambda x: x["features"]["value"]))), ("bs", F.col("o.b")))])
    known = lambda b: F.nullif(normalize_brand(b), F.lit(UNKNOWN))
    return texts.select(
        "cluster_id", F.col("o.idx").alias("idx"), F.transform("o", lambda x: F.array_position("titles", x["title"]).cast("int")).alias("title"),
        F.transform("o", lambda x: F.transform(x["features"]["value"], lambda v: F.array_position("texts", v).cast("int"))).alias("values"),
        F.transform("titles", lambda x: with_numeric_parts(title_model_words(clean_title(x)))).alias("words"), F.transform("texts", lambda v: numbers(clean_value(v))).alias("numbers"),
        F.transform("o", lambda x: F.array_position("bs", x["b"]).cast("int")).alias("brand"), F.transform("bs", known).alias("brands"),
    )


def cluster_places(offers: DataFrame) -> DataFrame:
    """cluster_brands with is_single and __start: the offers of the brand that stand before the cluster, singles last."""
    c = cluster_brands(offers).withColumn("is_single", F.col("n") == 1)
    return started(c, "brand", ["is_single", "cluster_id"], "n", "__start")


def place(offers: DataFrame, places: DataFrame) -> DataFrame:
    """Any columns of offers, among them cluster_id and idx, with brand, is_single and ord from cluster_places."""
    each = offers.join(places.select("cluster_id", "brand", "is_single", "__start"), "cluster_id")
    own = F.row_number().over(W.partitionBy("cluster_id").orderBy("idx"))
    return each.withColumn("ord", (F.col("__start") + own).cast("int")).drop("__start")


def annotate(offers: DataFrame, propagate: bool = True) -> DataFrame:
    """Offers with brand. With propagate a cluster's majority holds for all its offers; this uses the cluster, which is the truth that matching is to find."""
    if not propagate:
        return offers.withColumn("brand", extract_brand(F.col("features")))
    return offers.join(cluster_brands(offers).select("cluster_id", "brand"), "cluster_id")


def mark_single(offers: DataFrame) -> DataFrame:
    """is_single tells clusters of one offer."""
    return offers.withColumn("is_single", F.count("*").over(W.partitionBy("cluster_id")) == 1)


def cluster_sizes(offers: DataFrame) -> DataFrame:
    """cluster_id, is_single: mark_single with a row for each cluster."""
    return offers.groupBy("cluster_id").agg((F.count("*") == 1).alias("is_single"))


def clean_offers(offers: DataFrame) -> DataFrame:
    """Titles and feature values cleaned."""
    return offers.withColumn("title", clean_title(F.col("title"))).withColumn("features", clean_features(F.col("features")))


def with_order(offers: DataFrame) -> DataFrame:
    """ord: place in the order duplicates first, then cluster and index, within the brand; only orders inside a brand matter."""
    keys = ["brand", "is_single", "cluster_id"]
    runs = started(offers.groupBy(*keys).agg(F.count("*").alias("__n")), "brand", keys[1:], "__n", "__start")
    own = F.row_number().over(W.partitionBy(*keys).orderBy("idx"))
    return offers.drop("ord").join(runs.drop("__n"), keys).withColumn("ord", (F.col("__start") + own).cast("int")).drop("__start")


def prepare(offers: DataFrame, propagate: bool = True) -> DataFrame:
    """Offers with brand, is_single, ord, and clean texts. Order and, with propagate, brands are found for clusters and joined to their offers once."""
    if propagate:
        return clean_offers(place(offers, cluster_places(offers)))
    return clean_offers(with_order(mark_single(annotate(offers, propagate))))


def prepare_by_cluster(offers: DataFrame, by: str = "cluster_id") -> DataFrame:
    """prepare with propagate, and shingles (sorted): a cluster's offers come into one row (by names it, too), where its distinct texts are cleaned once. Written."""
    features = F.coalesce("features", F.array().cast("array<struct<key:string,value:string>>")).alias("features")
    one = F.struct("idx", "offer_id", "shop", "model_id", "title", features, brand_value(F.col("features")).alias("b"))
    found = offers.groupBy(by).agg(F.first("cluster_id").alias("id"), F.sort_array(F.collect_list(one)).alias("o"))
    texts = found.select(F.col("id").alias("cluster_id"), "o", *[F.array_distinct(c).alias(n) for n, c in (("titles", F.col("o.title")), ("texts", F.flatten(F.transform("o", lambda x: x["features"]["value"]))), ("bs", F.col("o.b")))])
    known = lambda b: F.nullif(normalize_brand(b), F.lit(UNKNOWN))
    texts = texts.select("cluster_id", "o", "titles", "texts", "bs", F.transform("titles", clean_title).alias("ct"), F.transform("texts", clean_value).alias("cv"), F.transform("bs", known).alias("brands"))
    texts = texts.select("*", F.transform("ct", lambda x: with_numeric_parts(title_model_words(x))).alias("words"), F.transform("cv", numbers).alias("numbers"), F.transform("o", lambda x: F.get("brands", F.array_position("bs", x["b"]).cast("int") - 1)).alias("own"))
    names = F.array_distinct(F.filter("own", lambda b: b.isNotNull()))
    top = F.array_min(F.transform(names, lambda b: F.named_struct(F.lit("less"), -F.size(F.filter("own", lambda x: x == b)), F.lit("b"), b)))["b"]
    each = texts.select("cluster_id", F.size("o").alias("n"), top.alias("top"), "titles", "texts", "ct", "cv", "words", "numbers", F.posexplode("o").alias("__at", "x"))
    at = lambda of, where, x: F.get(of, F.array_position(where, x).cast("int") - 1)
    none = F.array().cast("array<string>")
    sets = F.concat(F.array(F.coalesce(at("words", "titles", F.col("x.title")), none)), F.transform("x.features", lambda f: F.coalesce(at("numbers", "texts", f["value"]), none)))
    cleaned = F.transform("x.features", lambda f: F.struct(f["key"].alias("key"), F.coalesce(at("cv", "texts", f["value"]), F.lit("")).alias("value")))
    flat = each.select(
        "cluster_id", "n", "top", "__at", *[f"x.{c}" for c in ("idx", "offer_id", "shop", "model_id")], F.coalesce(at("ct", "titles", F.col("x.title")), F.lit("")).alias("title"),
        cleaned.alias("features"), F.sort_array(F.array_distinct(F.flatten(sets))).alias("shingles"),
    )
    flat = stage(flat, "offers")
    clusters = stage(flat.groupBy("cluster_id").agg(F.first("n").alias("n"), F.first("top").alias("top")), "clusters")
    branded = fill_tops(offers, clusters)
    places = started(branded.withColumn("is_single", F.col("n") == 1), "brand", ["is_single", "cluster_id"], "n", "__start").select("cluster_id", "brand", "is_single", "__start")
    return flat.drop("n", "top").join(small(places, clusters.count()), "cluster_id").withColumn("ord", (F.col("__start") + F.col("__at") + 1).cast("int")).drop("__start", "__at")
