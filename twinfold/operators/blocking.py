"""Shingles, MinHash signatures, band candidates, and what a preselection is worth. A block is a brand."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.similarity import ratio
from ..functions.tables import PRIME
from ..functions.text import shingles
from ..staging import parts, small, stage
from .graph import components
from .order import numbered

MIN_OFFERS = 4


def block_sizes(offers: DataFrame) -> DataFrame:
    return offers.groupBy("brand").agg(F.count("*").alias("n"))


def split_blocks(offers: DataFrame, min_offers: int = MIN_OFFERS) -> tuple[DataFrame, DataFrame]:
    """Offers of blocks with at least min_offers offers, for hashing, and those of smaller blocks, for comparing all."""
    sizes = block_sizes(offers).withColumn("large", F.col("n") >= min_offers).select("brand", "large")
    both = offers.join(sizes, "brand")
    return both.filter("large").drop("large"), both.filter("not large").drop("large")


def shingle_sets(offers: DataFrame, *keep: str) -> DataFrame:
    """keep and shingles: the distinct shingles of cleaned offers."""
    return offers.select(*keep, shingles(F.col("title"), F.col("features")).alias("shingles"))


def shingle_rows(offers: DataFrame) -> DataFrame:
    """brand, offer_id, ord, shingle of cleaned offers."""
    return offers.select("brand", "offer_id", "ord", F.explode(shingles(F.col("title"), F.col("features"))).alias("shingle"))


def shingle_df(rows: DataFrame) -> DataFrame:
    """brand, shingle, df."""
    return rows.groupBy("brand", "shingle").agg(F.count("*").alias("df"))


def shingle_df_by_cluster(sets: DataFrame, brands: DataFrame) -> DataFrame:
    """shingle_df of shingle_sets with cluster_id: counted in clusters first, which are then joined with their brands."""
    counts = sets.select("cluster_id", F.explode("shingles").alias("shingle")).groupBy("cluster_id", "shingle").agg(F.count("*").alias("n"))
    return counts.join(brands.select("cluster_id", "brand"), "cluster_id").groupBy("brand", "shingle").agg(F.sum("n").alias("df"))


def filter_by_df(rows: DataFrame, offers: DataFrame, min_df: int = 2, max_share: float = 0.5) -> DataFrame:
    """Rows whose shingle is in min_df to max_share of the block's offers; an offer that would lose all keeps all."""
    rows = stage(rows, "shingles")
    limits = shingle_df(rows).join(block_sizes(offers), "brand")
    fine = limits.select("brand", "shingle", ((F.col("df") >= min_df) & (F.col("df") <= max_share * F.col("n"))).alias("fine"))
    marked = rows.join(fine, ["brand", "shingle"])
    any_fine = F.max("fine").over(W.partitionBy("offer_id"))  # an offer's shingles are few
    return marked.withColumn("any", any_fine).filter(F.col("fine") | ~F.col("any")).select(*rows.columns)


#: Shingles of a brand outside the limits up to which each offer is compared with their list; beyond, rows of shingles are joined with them.
MAX_UNFIT = 1_000


def filter_sets(sets: DataFrame, min_df: int = 2, max_share: float = 0.5, most: int = MAX_UNFIT, weight: Column | None = None) -> DataFrame:
    """filter_by_df of written shingle_sets with brand and offer_id: the same sets, an offer of a set in a row, or weight offers.

    Shingles outside the limits are few where most stand in several offers: then they are taken out of each set, without a row for each shingle.
    """
    weight = F.lit(1) if weight is None else weight
    each = sets.select("brand", weight.alias("w"), F.explode("shingles").alias("shingle")).groupBy("brand", "shingle").agg(F.sum("w").alias("df"))
    limits = each.join(sets.groupBy("brand").agg(F.sum(weight).alias("n")), "brand")
    unfit = stage(limits.filter((F.col("df") < min_df) | (F.col("df") > max_share * F.col("n"))).select("brand", "shingle"), "unfit")
    if (unfit.groupBy("brand").count().agg(F.max("count")).first()[0] or 0) <= most:
        lists = unfit.groupBy("brand").agg(F.collect_set("shingle").alias("unfit"))
        fit = F.array_except("shingles", F.coalesce("unfit", F.array().cast("array<string>")))
        return sets.join(lists, "brand", "left").withColumn("fit", fit).withColumn("shingles", F.when(F.size("fit") > 0, F.col("fit")).otherwise(F.col("shingles"))).select(*sets.columns)
    rows = sets.select("brand", "offer_id", F.explode("shingles").alias("shingle"))
    kept = rows.join(unfit, ["brand", "shingle"], "left_anti").groupBy("offer_id").agg(F.collect_set("shingle").alias("fit"))
    return sets.join(kept, "offer_id", "left").withColumn("shingles", F.coalesce("fit", "shingles")).select(*sets.columns)


def exploded(sets: DataFrame) -> DataFrame:
    """shingle_rows of shingle_sets."""
    return sets.select(*[c for c in sets.columns if c != "shingles"], F.explode("shingles").alias("shingle"))


def shingle_ids(kept: DataFrame, dense: bool = True) -> DataFrame:
    """brand, shingle, id. Dense ids count a block's shingles by first appearance (order of offers, then shingle); otherwise a 31-bit hash, which no block's task has to number."""
    if not dense:
        return kept.select("brand", "shingle").distinct().withColumn("id", F.xxhash64("shingle").bitwiseAND(F.lit((1 << 31) - 1)))
    first = kept.groupBy("brand", "shingle").agg(F.min("ord").alias("ord"))
    return numbered(first, "brand", ["ord", "shingle"], "id").select("brand", "shingle", (F.col("id") - 1).cast("long").alias("id"))


def hash_family(num_perm: int, seed: int) -> tuple[list[int], list[int]]:
    """Offsets and multipliers, from the seeded generator."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, PRIME, size=num_perm, dtype=np.uint32)
    b = rng.integers(0, PRIME, size=num_perm, dtype=np.uint32)
    return a.tolist(), b.tolist()


def minhash(ids: Column, a: list[int], b: list[int], prime: int = PRIME) -> Column:
    """For each hash function the least (a + b * id) mod prime; prime without ids."""
    perms = F.array(*[F.struct(F.lit(x).cast("long").alias("a"), F.lit(y).cast("long").alias("b")) for x, y in zip(a, b, strict=True)])
    return F.transform(perms, lambda p: F.coalesce(F.array_min(F.transform(ids, lambda x: (p["a"] + p["b"] * x) % F.lit(prime))), F.lit(prime).cast("long")))


def signatures(offers: DataFrame, num_perm: int = 120, seed: int = 123, min_offers: int = MIN_OFFERS, dense: bool = True) -> DataFrame:
    """brand, offer_id, sig of the offers in large blocks. An offer without shingles has the prime everywhere."""
    large, _ = split_blocks(offers, min_offers)
    return set_signatures(shingle_sets(large, "brand", "offer_id", "ord"), num_perm, seed, dense)


def set_signatures(sets: DataFrame, num_perm: int, seed: int, dense: bool = True) -> DataFrame:
    """signatures of shingle_sets of large blocks. Equal sets of a brand are hashed once."""
    return sets.select("brand", "offer_id", F.sort_array("shingles").alias("raw")).join(hashed_sets(sets, num_perm, seed, dense), ["brand", "raw"]).select("brand", "offer_id", "sig")


def hashed_sets(sets: DataFrame, num_perm: int, seed: int, dense: bool = True) -> DataFrame:
    """brand, raw (sorted shingles), sig: set_signatures of the distinct sets of a brand, which stand for their offers in all that is counted."""
    own = sets.select("brand", F.sort_array("shingles").alias("shingles"), "ord", "offer_id").groupBy("brand", "shingles").agg(F.min("ord").alias("ord"), F.min("offer_id").alias("offer_id"), F.count("*").alias("n"))
    own = stage(own.withColumn("raw", F.col("shingles")), "sets")
    kept = stage(filter_sets(own, weight=F.col("n")).withColumn("shingles", F.sort_array("shingles")).select("brand", "raw", "shingles", "ord"), "kept")
    rows = kept.groupBy("brand", "shingles").agg(F.min("ord").alias("ord")).select("brand", "shingles", "ord", F.explode("shingles").alias("shingle"))
    rows = stage(rows, "distinct_sets")
    ids = rows.join(shingle_ids(rows, dense), ["brand", "shingle"]).repartition(parts(rows), "brand", "shingles").groupBy("brand", "shingles").agg(F.collect_set("id").alias("ids"))
    a, b = hash_family(num_perm, seed)
    hashed = ids.select("brand", "shingles", minhash(F.col("ids"), a, b).alias("sig"))
    empty = F.array_repeat(F.lit(PRIME).cast("long"), num_perm)
    return kept.join(hashed, ["brand", "shingles"], "left").select("brand", "raw", F.coalesce("sig", empty).alias("sig"))


def numbered_classes(sets: DataFrame, num_perm: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """brand, no, sig of the classes of equal signatures of shingle_sets of large blocks, and brand, raw, no of the distinct sorted sets. Both written."""
    hashed = stage(hashed_sets(sets, num_perm, seed), "hashed")
    classes = stage(hashed.groupBy("brand", "sig").agg(F.count("*").alias("sets")).select("brand", "sig").withColumn("no", F.monotonically_increasing_id()), "classes")
    return classes, stage(hashed.join(classes, ["brand", "sig"]).select("brand", "raw", "no"), "setclasses")


def bands(sigs: DataFrame, b: int, r: int, k: int | None = None, *keep: str) -> DataFrame:
    """brand, offer_id, keep, band, key: the signature's first k places in b bands of r."""
    if k is not None and k != b * r:
        raise ValueError(f"{b} bands of {r} don't make {k}")
    keys = F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda j: F.struct(j.alias("band"), F.array_join(F.slice("sig", j * r + 1, F.lit(r)), ",").alias("key")))
    fits = F.when(F.size("sig") < b * r, F.raise_error(F.lit("signature shorter than the bands"))).otherwise(keys)
    return sigs.select("brand", "offer_id", *keep, F.explode(fits).alias("x")).select("brand", "offer_id", *keep, "x.band", "x.key")


def band_pairs(rows: DataFrame) -> DataFrame:
    """brand, oid1, oid2 (oid1 < oid2): offers that share a band, each pair once."""
    a, b = (rows.select("brand", "band", "key", F.col("offer_id").alias(n)) for n in ("oid1", "oid2"))
    return a.join(b, ["brand", "band", "key"]).filter("oid1 < oid2").select("brand", "oid1", "oid2").distinct()


def signature_classes(sigs: DataFrame) -> DataFrame:
    """brand, sig, class: offers of a brand with equal signatures share all bands; the smallest offer names their class."""
    return sigs.groupBy("brand", "sig").agg(F.min("offer_id").alias("class"))


def class_pairs(classes: DataFrame, b: int, r: int, by: str = "class") -> DataFrame:
    """brand, class1, class2 (class1 < class2, of the column by): classes that share a band, each pair once. Equal signatures don't meet each other here.

    A pair is taken at the first band that it shares, so that pairs need not be dealt out again to be told apart.
    """
    rows = bands(classes.select("brand", "sig", F.col(by).alias("offer_id")), b, r, None, "sig")
    one, two = (rows.select("brand", "band", "key", F.col("offer_id").alias(f"class{i}"), F.col("sig").alias(f"sig{i}")) for i in (1, 2))
    shared = F.lit(False)
    for j in range(b - 1):
        equal = F.col("band") > j
        for k in range(j * r, j * r + r):
            equal &= F.get("sig1", F.lit(k)) == F.get("sig2", F.lit(k))
        shared |= equal
    return one.join(two, ["brand", "band", "key"]).filter((F.col("class1") < F.col("class2")) & ~shared).select("brand", "class1", "class2")


def class_members(sigs: DataFrame, b: int, r: int) -> tuple[DataFrame, DataFrame]:
    """signature_classes of signatures cut to the bands, with no, their number; and brand, class, no, offer_id. Both written."""
    if b * r > 0:
        sigs = sigs.select("brand", "offer_id", F.when(F.size("sig") < b * r, F.raise_error(F.lit("signature shorter than the bands"))).otherwise(F.slice("sig", 1, b * r)).alias("sig"))
    classes = stage(signature_classes(sigs).withColumn("no", F.monotonically_increasing_id()), "classes")
    return classes, stage(sigs.join(classes, ["brand", "sig"]).select("brand", "class", "no", "offer_id"), "members")


def lsh_pairs(sigs: DataFrame, b: int, r: int) -> DataFrame:
    """brand, oid1, oid2 (oid1 < oid2): offers that share a band, each pair once: pairs of classes with their members, and pairs inside classes."""
    classes, members = class_members(sigs, b, r)
    one, two = (members.select("brand", F.col("no").alias(f"class{i}"), F.col("offer_id").alias(f"o{i}")) for i in (1, 2))
    across = class_pairs(classes, b, r, "no").join(one, ["brand", "class1"]).join(two, ["brand", "class2"]).select("brand", F.least("o1", "o2").alias("oid1"), F.greatest("o1", "o2").alias("oid2"))
    inside = one.join(two.withColumnRenamed("class2", "class1"), ["brand", "class1"]).filter("o1 < o2").select("brand", F.col("o1").alias("oid1"), F.col("o2").alias("oid2"))
    return across.unionByName(inside)


def pair_counts(sigs: DataFrame, keys: DataFrame, b: int, r: int, more: DataFrame | None = None) -> DataFrame:
    """a, b, n_pairs: how many of lsh_pairs, and of more (oid1, oid2), have key a first and key b second, of keys (offer_id, key).

    Offers of a class with equal keys form a group. Two groups stand for the product of their sizes where all offers of one are before
    those of the other, or their keys are equal; only groups that mix in order are expanded to pairs of offers.
    """
    classes, members = class_members(sigs, b, r)
    keyed = stage(members.join(keys, "offer_id").select(F.col("no").alias("class"), "key", "offer_id"), "keyed")
    groups = stage(keyed.groupBy("class", "key").agg(F.count("*").alias("n"), F.min("offer_id").alias("lo"), F.max("offer_id").alias("hi")).withColumn("g", F.monotonically_increasing_id()), "groups")
    one, two = (groups.select(*[F.col(c).alias(f"{c}{i}") for c in groups.columns]) for i in (1, 2))
    across = class_pairs(classes, b, r, "no").join(one, "class1").join(two, "class2")
    inside = one.join(two, F.col("class1") == F.col("class2")).filter("g1 <= g2")
    n, ahead, mixed = F.col("n1") * F.col("n2"), F.col("hi1") < F.col("lo2"), (F.col("key1") != F.col("key2")) & (F.col("hi1") >= F.col("lo2")) & (F.col("hi2") >= F.col("lo1"))
    count = F.when(F.col("g1") == F.col("g2"), F.expr("n1 * (n1 - 1) div 2")).otherwise(n)
    rows = [t.select(F.when(ahead, F.col("key1")).otherwise(F.col("key2")).alias("a"), F.when(ahead, F.col("key2")).otherwise(F.col("key1")).alias("b"), F.when(~mixed, count).alias("n"), F.when(mixed, F.col("g1")).alias("g1"), F.when(mixed, F.col("g2")).alias("g2")) for t in (across, inside)]
    met = stage(rows[0].unionByName(rows[1]).filter("n is null or n > 0"), "groupmeetings")
    offers = stage(keyed.join(groups.select("class", "key", "g"), ["class", "key"]).select("g", "key", "offer_id"), "groupoffers")
    o1, o2 = (offers.select(F.col("g").alias(f"g{i}"), F.col("key").alias(f"key{i}"), F.col("offer_id").alias(f"o{i}")) for i in (1, 2))
    before, one_pair = F.col("o1") < F.col("o2"), F.lit(1).cast("long").alias("n")
    each = met.filter("n is null").select("g1", "g2").join(o1, "g1").join(o2, "g2").select(F.when(before, F.col("key1")).otherwise(F.col("key2")).alias("a"), F.when(before, F.col("key2")).otherwise(F.col("key1")).alias("b"), one_pair)
    counted = met.filter("n is not null").select("a", "b", "n").unionByName(each)
    if more is not None:
        counted = counted.unionByName(more.join(keys.toDF("oid1", "a"), "oid1").join(keys.toDF("oid2", "b"), "oid2").select("a", "b", one_pair))
    return counted.groupBy("a", "b").agg(F.sum("n").alias("n_pairs"))


#: Bands up to which partners are counted by sets of bands.
MAX_BANDS = 10


def degrees(sigs: DataFrame, b: int, r: int) -> DataFrame:
    """offer_id, degree of the offers in sigs: how many of lsh_pairs they are in. Counted by classes; pairs of offers are not made."""
    classes, members = class_members(sigs, b, r)
    sizes = members.groupBy("no").agg(F.count("*").alias("n"))
    return members.join(class_degrees(classes, sizes, b, r), "no").select("offer_id", "degree")


def class_degrees(classes: DataFrame, sizes: DataFrame, b: int, r: int) -> DataFrame:
    """no, degree of the offers of each class of classes (brand, sig, no) with sizes (no, n): those of all classes that share a band with it, less one.

    Neither pairs of offers nor of classes are made: of the classes in a band's bucket those are counted that share no earlier band, by adding
    and taking off the offers with equal bands for each set of earlier bands. A task has all rows of its buckets, one for each class and band.
    """
    if b > MAX_BANDS:
        return _paired_degrees(classes, sizes, b, r)
    upto = lambda j: F.slice("sig", F.lit(1), (j + 1) * r)
    rows = classes.join(sizes, "no").select("brand", "no", "n", "sig", F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("band"))
    rows = rows.select("brand", "no", "n", "band", F.slice("sig", F.col("band") * r + 1, F.lit(r)).alias("key"), upto(F.col("band")).alias("sig"))
    rows = rows.repartition(parts(rows), "brand", "band", "key").select("no", "n", "band", "brand", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := list(batches)):
            return
        t = pa.Table.from_batches(held).combine_chunks()
        band, n, no = (t.column(c).to_numpy() for c in ("band", "n", "no"))
        brand = t.column("brand").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        for j in np.unique(band).tolist():
            own = np.flatnonzero(band == j)
            sig = t.column("sig").combine_chunks().take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
            codes = []
            for i in range(j + 1):
                code = brand[own].astype("int64")
                for k in range(i * r, i * r + r):
                    code = _joined(code, np.unique(sig[:, k], return_inverse=True)[1].ravel())
                codes.append(code)
            total = np.zeros(len(own), "int64")

            def add(code: np.ndarray, i: int, sign: int) -> None:
                sums = np.zeros(code.max() + 1, "int64")
                np.add.at(sums, code, n[own])
                total[:] += sign * sums[code]  # noqa: B023
                for k in range(i, j):  # noqa: B023
                    add(_joined(code, codes[k]), k + 1, -sign)  # noqa: B023

            add(codes[j], 0, 1)
            yield pa.RecordBatch.from_arrays([pa.array(no[own]), pa.array(total)], ["no", "met"])

    met = rows.mapInArrow(run, "no long, met long").groupBy("no").agg(F.sum("met").alias("met"))
    return met.select("no", (F.col("met") - 1).cast("int").alias("degree"))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers from 0 of the pairs of two arrays of numbers below 2^31."""
    return np.unique(a.astype("int64") << 32 | b, return_inverse=True)[1].ravel()


def _paired_degrees(classes: DataFrame, sizes: DataFrame, b: int, r: int) -> DataFrame:
    """class_degrees by pairs of classes, for many bands."""
    met = class_pairs(classes, b, r, "no").select(F.explode(F.array(F.struct(F.col("class1").alias("no"), F.col("class2").alias("other")), F.struct(F.col("class2").alias("no"), F.col("class1").alias("other")))).alias("x"))
    others = met.select("x.*").join(sizes.toDF("other", "n"), "other").groupBy("no").agg(F.sum("n").alias("others"))
    return sizes.join(others, "no", "left").select("no", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).cast("int").alias("degree"))


def lsh_components(sigs: DataFrame, b: int, r: int) -> DataFrame:
    """components of lsh_pairs: node, label. Of the classes that share a band each is tied to the least one; a class of several offers is connected by itself."""
    classes, members = class_members(sigs, b, r)
    rows = stage(bands(classes.select("brand", "sig", F.col("class").alias("offer_id")), b, r).withColumnRenamed("offer_id", "class"), "classbands")
    least = rows.groupBy("brand", "band", "key").agg(F.min("class").alias("least"))
    ties = rows.join(least, ["brand", "band", "key"]).filter("class <> least").select(F.col("class").alias("a"), F.col("least").alias("b"))
    several = members.groupBy("class").agg(F.count("*").alias("n")).filter("n > 1").select("class", F.col("class").alias("own"))
    label = components(ties).toDF("class", "label").join(several, "class", "full").select("class", F.coalesce("label", "own").alias("label"))
    return members.join(label, "class").select(F.col("offer_id").alias("node"), "label")


def adjacency(pairs: DataFrame, offers: DataFrame) -> DataFrame:
    """offer_id and the set of its partners, empty for offers without."""
    both = pairs.select(F.col("oid1").alias("offer_id"), F.col("oid2").alias("other")).unionByName(pairs.select(F.col("oid2").alias("offer_id"), F.col("oid1").alias("other")))
    sets = both.groupBy("offer_id").agg(F.collect_set("other").alias("partners"))
    return offers.select("offer_id").join(sets, "offer_id", "left").withColumn("partners", F.coalesce("partners", F.array().cast("array<string>")))


def block_pairs(offers: DataFrame, order: str = "ord") -> DataFrame:
    """All pairs of each block, oriented by order."""
    a, b = (offers.select("brand", F.col("offer_id").alias(f"oid{i}"), F.col(order).alias(f"o{i}")) for i in (1, 2))
    return a.join(b, "brand").filter("o1 < o2").select("brand", "oid1", "oid2")


def block_partners(offers: DataFrame) -> DataFrame:
    """brand, oid1, n, low, high: how many partners block_pairs gives each first offer, and the least and greatest; the pairs are not made."""
    later = W.partitionBy("brand").orderBy(F.desc("ord")).rowsBetween(W.unboundedPreceding, -1)
    return offers.select("brand", F.col("offer_id").alias("oid1"), F.count("*").over(later).alias("n"), F.min("offer_id").over(later).alias("low"), F.max("offer_id").over(later).alias("high")).filter("n > 0")


def ordered_partners(offers: DataFrame) -> DataFrame:
    """block_partners of blocks of any size in the order of offer_id: the partners of an offer are those behind it."""
    at = stage(numbered(offers.select("brand", "offer_id"), "brand", ["offer_id"], "at"), "places")
    ends = at.groupBy("brand").agg(F.count("*").alias("size"), F.max("offer_id").alias("high"))
    behind = at.select("brand", (F.col("at") - 1).alias("at"), F.col("offer_id").alias("low"))
    return at.join(behind, ["brand", "at"]).join(ends, "brand").select("brand", F.col("offer_id").alias("oid1"), (F.col("size") - F.col("at")).alias("n"), "low", "high")


def every_partner(offers: DataFrame, min_offers: int = MIN_OFFERS) -> DataFrame:
    """block_partners of every_pair."""
    large, small = split_blocks(offers, min_offers)
    return ordered_partners(large).unionByName(block_partners(small))


def candidates(offers: DataFrame, sigs: DataFrame, b: int, r: int, min_offers: int = MIN_OFFERS, strict: bool = True) -> DataFrame:
    """Band pairs of large blocks and all pairs of small ones. Unless strict, signatures shorter than the bands give no pairs, in place of an error."""
    _, small = split_blocks(offers, min_offers)
    return lsh_pairs(sigs if strict else sigs.filter(F.size("sig") >= b * r), b, r).unionByName(block_pairs(small))


def block_digest(idx: list[int], sets: list[frozenset[str]], kept: list[frozenset[str]] | None, raw: list[bytes] | None, b: int, width: int) -> list[tuple[int, int, int, int]]:
    """idx of the first offer, its number of partners, and idx of the least and greatest, of the candidates of a block whose offer ids differ by idx only.

    sets: shingles of the offers in the order of idx. kept and raw: the distinct filtered sets and their signatures as bytes (width of a band), none for a small block.
    """
    n = len(idx)
    by_id = sorted(range(n), key=[str(i) for i in idx].__getitem__)
    if kept is None:
        rank = {k: p for p, k in enumerate(by_id)}
        out, low, high = [], rank[n - 1], rank[n - 1]
        for k in range(n - 2, -1, -1):
            out.append((idx[k], n - 1 - k, idx[by_id[low]], idx[by_id[high]]))
            low, high = min(low, rank[k]), max(high, rank[k])
        return out
    own = dict.fromkeys(kept, 0)
    for p, k in enumerate(by_id):
        own[sets[k]] |= 1 << p
    met: dict[tuple[int, bytes], int] = {}
    keys = [[(j, sig[j * width : j * width + width]) for j in range(b)] for sig in raw]
    for s, each in zip(kept, keys, strict=True):
        for key in each:
            met[key] = met.get(key, 0) | own[s]
    all_met = {}
    for s, each in zip(kept, keys, strict=True):
        m = 0
        for key in each:
            m |= met[key]
        all_met[s] = m
    out = []
    for p, k in enumerate(by_id):
        if m := all_met[sets[k]] >> (p + 1):
            out.append((idx[k], m.bit_count(), idx[by_id[p + (m & -m).bit_length()]], idx[by_id[p + m.bit_length()]]))
    return out


def fit_sets(sets: list[frozenset[str]], min_df: int = 2, max_share: float = 0.5) -> list[frozenset[str]]:
    """filter_sets of one block."""
    df = Counter(s for each in sets for s in each)
    fine = {s for s, n in df.items() if min_df <= n <= max_share * len(sets)}
    memo = {each: each & fine or each for each in set(sets)}
    return [memo[each] for each in sets]


def cluster_candidates(clusters: DataFrame, num_perm: int, seed: int, b: int, r: int, min_offers: int = MIN_OFFERS) -> DataFrame:
    """cluster_id, top and the digest of candidates where each cluster is a block: oid1, n, low, high, one row a cluster (rows: array).

    clusters: brand.cluster_rows. A cluster's offers are in a row, so all from its shingles to its pairs is done in the task that has it; what is
    filtered, numbered, hashed and met is as in filter_sets, shingle_ids, set_signatures and candidates.
    """
    a, m = (np.array(x, "int64")[:, None] for x in hash_family(num_perm, seed))
    names = ("at", "n", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            blocks, chosen, tops = [], [], []
            for idx, title, values, words, numbers, brand, brands in zip(*(t.column(c).to_pylist() for c in ("idx", "title", "values", "words", "numbers", "brand", "brands")), strict=True):
                seen = Counter(brands[x - 1] for x in brand if x and brands[x - 1] is not None)
                tops.append(min(((-n, x) for x, n in seen.items()), default=(0, None))[1])
                memo: dict[tuple, frozenset[str]] = {}
                sets = []
                for k in sorted(range(len(idx)), key=idx.__getitem__):
                    key = (title[k], *values[k])
                    if (one := memo.get(key)) is None:
                        one = memo[key] = frozenset(words[title[k] - 1] if title[k] else ()).union(*[numbers[v - 1] for v in values[k] if v])
                    sets.append(one)
                idx.sort()
                if len(idx) < min_offers:
                    blocks.append((idx, sets, None, 0))
                    continue
                sets = fit_sets(sets)
                kept = list(dict.fromkeys(sets))
                number: dict[str, int] = {}
                for each in kept:  # by first appearance, then shingle
                    for s in sorted(each - number.keys()):
                        number[s] = len(number)
                chosen.extend([number[s] for s in each] for each in kept)
                blocks.append((idx, sets, kept, len(kept)))
            sizes = np.array([len(c) for c in chosen], "int64")
            ids = np.array([x for c in chosen for x in c], "int64")
            table = (a + m * np.arange(ids.max() + 1 if len(ids) else 0)) % PRIME
            sigs = np.full((len(chosen), num_perm), PRIME, "int64")
            if len(ids):
                sigs[sizes > 0] = np.minimum.reduceat(table[:, ids], (sizes.cumsum() - sizes)[sizes > 0], axis=1).T
            raw, at, rows, ends = [x.tobytes() for x in sigs], 0, [], [0]
            for idx, sets, kept, size in blocks:
                rows.extend(block_digest(idx, sets, kept, raw[at : at + size], b, 8 * r))
                at += size
                ends.append(len(rows))
            flat = np.array(rows, "int64").reshape(-1, 4)
            lists = pa.ListArray.from_arrays(pa.array(ends, "int32"), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(4)], names))
            yield pa.RecordBatch.from_arrays([t.column("cluster_id"), pa.array(tops, "string"), lists], ["cluster_id", "top", "rows"])

    return clusters.mapInArrow(run, "cluster_id string, top string, rows array<struct<at:long,n:long,low:long,high:long>>")


def every_pair(offers: DataFrame, min_offers: int = MIN_OFFERS) -> DataFrame:
    """All pairs of all blocks; large blocks by id, small ones by order."""
    large, small = split_blocks(offers, min_offers)
    return block_pairs(large, "offer_id").unionByName(block_pairs(small))


def factor_pairs(n: int) -> list[tuple[int, int]]:
    """All (bands, rows) with bands * rows = n, by bands."""
    return [(b, n // b) for b in range(1, n + 1) if n % b == 0]


def band_configs(num_perm: int, delta: int = 2, above: bool = True) -> list[tuple[int, int, int]]:
    """(k, bands, rows) for each k within delta of num_perm."""
    return [(k, b, r) for k in range(max(1, num_perm - delta), num_perm + delta * above + 1) for b, r in factor_pairs(k)]


def pair_quality(tp: Column, cand: Column, true: Column, possible: Column) -> dict[str, Column]:
    """Share of true pairs found (pc), share of candidates true (pq), share of pairs compared (fc), harmonic mean of pc and pq."""
    pc, pq, fc = ratio(tp.cast("double"), true), ratio(tp.cast("double"), cand), ratio(cand.cast("double"), possible)
    return {"pc": pc, "pq": pq, "fc": fc, "f1_star": ratio(2 * pq * pc, pq + pc)}


def _half(n: Column) -> Column:
    return F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0)).cast("long")


def lsh_metrics(pairs: DataFrame, offers: DataFrame) -> DataFrame:
    """One row: tp, true_pairs, cand_pairs, possible_pairs and pair_quality, over the blocks of offers; truth by model_id within blocks."""
    model = offers.select("offer_id", "model_id")
    hit = pairs.join(model.toDF("oid1", "m1"), "oid1").join(model.toDF("oid2", "m2"), "oid2")
    found = hit.agg(F.count_if(F.col("m1").eqNullSafe(F.col("m2"))).alias("tp"), F.count("*").alias("cand_pairs"))
    true = offers.groupBy("brand", "model_id").count().agg(_half(F.col("count")).alias("true_pairs"))
    possible = offers.groupBy("brand").count().agg(_half(F.col("count")).alias("possible_pairs"))
    one = found.crossJoin(true).crossJoin(possible)  # three single rows
    return one.select("*", *[c.alias(k) for k, c in pair_quality(*map(F.col, ("tp", "cand_pairs", "true_pairs", "possible_pairs"))).items()])


def sweep(sigs: DataFrame, offers: DataFrame, configs: list[tuple[int, int]]) -> DataFrame:
    """b, r and lsh_metrics of each configuration, in one plan.

    Pairs are counted by classes of equal signatures and never made: a pair of classes stands for the product of their sizes, and its
    true pairs for the products of their sizes in each model.
    """
    model = offers.select("offer_id", "model_id")
    classes = stage(signature_classes(sigs), "classes")
    members = sigs.join(classes, ["brand", "sig"]).join(model, "offer_id")
    by_model = stage(members.groupBy("class", "model_id").agg(F.count("*").alias("n")), "bymodel")
    sizes = by_model.groupBy("class").agg(F.sum("n").alias("n"))
    n = F.col("n")
    inside = by_model.agg(_half(n).alias("tp0")).crossJoin(sizes.agg(_half(n).alias("c0")))  # two single rows
    true = offers.groupBy("brand", "model_id").count().agg(_half(F.col("count")).alias("true_pairs"))
    possible = offers.groupBy("brand").count().agg(_half(F.col("count")).alias("possible_pairs"))
    fixed = inside.crossJoin(true).crossJoin(possible)  # single rows
    pairs = None
    for b, r in configs:
        each = class_pairs(classes, b, r).select(F.lit(b).alias("b"), F.lit(r).alias("r"), "class1", "class2")
        pairs = each if pairs is None else pairs.unionByName(each)
    pairs = stage(pairs, "classpairs")
    found = pairs.join(sizes.toDF("class1", "n1"), "class1").join(sizes.toDF("class2", "n2"), "class2").groupBy("b", "r").agg(F.sum(F.col("n1") * F.col("n2")).alias("c1"))
    hit = pairs.join(by_model.toDF("class1", "model_id", "n1"), "class1").join(by_model.toDF("class2", "model_id", "n2"), ["class2", "model_id"]).groupBy("b", "r").agg(F.sum(F.col("n1") * F.col("n2")).alias("tp1"))
    rows = offers.sparkSession.createDataFrame(configs, "b int, r int").join(found, ["b", "r"], "left").join(hit, ["b", "r"], "left").crossJoin(fixed)  # one row each
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = rows.select("b", "r", (zero(F.col("tp1")) + F.col("tp0")).alias("tp"), (zero(F.col("c1")) + F.col("c0")).alias("cand_pairs"), "true_pairs", "possible_pairs")
    return rows.select("*", *[c.alias(k) for k, c in pair_quality(*map(F.col, ("tp", "cand_pairs", "true_pairs", "possible_pairs"))).items()])


def best_config(metrics: DataFrame, min_pc: float = 0.8) -> DataFrame:
    """The row with the smallest fc below 1 whose pc is above min_pc, ties to fewer bands; no row if none qualifies."""
    return metrics.filter((F.col("pc") > min_pc) & (F.col("fc") < 1)).orderBy("fc", "b").limit(1)
