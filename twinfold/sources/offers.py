"""Where offers come from: JSON files of clusters of offers, and a view over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import parts

FILE_SCHEMA = "map<string, array<struct<title:string, shop:string, modelID:string, featuresMap:map<string,string>>>>"


def from_json(spark: SparkSession, path: str) -> DataFrame:
    """Offers of a JSON object of clusters, in file order: cluster_id, cluster_pos, idx, offer_id, shop, model_id, title, features.

    Of equal keys the first place and the last value count. A file is one value, so it must fit in a
    task; several files make several batches of clusters.
    """
    pairs = F.map_entries(F.from_json("value", FILE_SCHEMA))
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(pairs).alias("pos", "kv")).select("pos", "kv.key", "kv.value")
    once = raw.groupBy("key").agg(F.min("pos").alias("cluster_pos"), F.max_by("value", "pos").alias("offers"))
    each = once.select(F.col("key").alias("cluster_id"), "cluster_pos", F.posexplode("offers").alias("idx", "o"))
    entries = F.coalesce(F.map_entries("o.featuresMap"), F.array().cast("array<struct<key:string,value:string>>"))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    features = F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"].alias("value")))
    return each.select("cluster_id", "cluster_pos", "idx", offer_id("cluster_id", "idx"), F.col("o.shop").alias("shop"), F.col("o.modelID").alias("model_id"), F.col("o.title").alias("title"), features.alias("features"))


def offer_id(cluster: str, idx: str):  # noqa: ANN201
    return F.concat_ws("#", cluster, idx).alias("offer_id")


def first_clusters(offers: DataFrame, n: int) -> DataFrame:
    """Offers of the first n clusters in file order."""
    return offers.filter(F.col("cluster_pos") < n)


def lookup(ids: DataFrame, offers: DataFrame) -> DataFrame:
    """ids (offer_id) with their offers."""
    return ids.join(offers, "offer_id", "left")


#: Offers derived from part and lineitem, in SQL that Spark and DuckDB both run; features in columns.
FLAT_SQL = """
SELECT cast(part AS varchar(20)) AS cluster_id, cast(idx AS int) AS idx, concat(cast(part AS varchar(20)), '#', cast(idx AS varchar(20))) AS offer_id,
       concat('shop', cast(supp % 4 AS varchar(20))) AS shop, cast(part AS varchar(20)) AS model_id,
       concat(brand, ' ', name, ' ', cast(20 + size AS varchar(20)), CASE supp % 3 WHEN 0 THEN '"' WHEN 1 THEN '-inch' ELSE ' inches' END,
              CASE WHEN supp % 7 = 0 THEN '' ELSE concat(' MX', cast(part AS varchar(20)), 'B', cast(size AS varchar(20))) END,
              CASE supp % 2 WHEN 0 THEN ' 120Hz' ELSE ' 120 hertz' END) AS title,
       CASE WHEN supp % 4 = 1 THEN 'Brand Name' ELSE 'Brand' END AS k1, CASE WHEN supp % 5 = 0 THEN '' ELSE concat(brand, CASE WHEN supp % 3 = 1 THEN ' Inc.' ELSE '' END) END AS v1,
       CASE WHEN supp % 4 = 2 THEN 'Screen Size Class' ELSE 'Screen Size' END AS k2, concat(cast(20 + size AS varchar(20)), CASE WHEN supp % 2 = 0 THEN ' Inches' ELSE '"' END) AS v2,
       'Maximum Resolution' AS k3, CASE WHEN part % 3 = 0 THEN '1920 x 1080' WHEN part % 3 = 1 THEN '1366 x 768' ELSE concat('4:3 ', CASE WHEN supp % 2 = 0 THEN '1024x768' ELSE 'XGA' END) END AS v3,
       'Weight' AS k4, concat(cast(10 + size AS varchar(20)), '.', cast(part % 10 AS varchar(20)), CASE WHEN supp % 3 = 0 THEN ' pounds' ELSE ' lbs.' END) AS v4
FROM (SELECT d.part, d.supp, p.p_brand AS brand, p.p_name AS name, p.p_size AS size, row_number() OVER (PARTITION BY d.part ORDER BY d.supp) - 1 AS idx
      FROM (SELECT DISTINCT l_partkey AS part, l_suppkey AS supp FROM lineitem) d JOIN part p ON p.p_partkey = d.part) x
"""


def from_tables(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """The derived offers with features as an array, and keep, of which part is the number that cluster_id spells. Lines are dealt by part once, which serves the distinct rows, the join, the numbering and groups by part."""
    part, lineitem = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem"))
    lineitem = lineitem.select("l_partkey", "l_suppkey").repartition(parts(lineitem), "l_partkey")
    query = FLAT_SQL.replace("FROM lineitem", "FROM {lineitem}").replace("JOIN part p", "JOIN {part} p")
    flat = spark.sql("".join(["SELECT ", *[f"{c}, " for c in keep], query.strip().removeprefix("SELECT ")]), part=part, lineitem=lineitem)
    features = F.array(*[F.struct(F.col(f"k{i}").alias("key"), F.col(f"v{i}").alias("value")) for i in range(1, 5)])
    return flat.withColumn("cluster_pos", F.col("cluster_id").cast("int")).withColumn("features", features).drop(*[f"{c}{i}" for c in "kv" for i in range(1, 5)])


def write_curve(curve: DataFrame, path: str) -> None:
    """A curve, of a few hundred rows at most, as one CSV file."""
    curve.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def plot_curves(rows: list[dict], folder: str, metrics: tuple[str, ...], x: str = "fc") -> list[str]:
    """One picture of each metric against the fraction of comparisons, where matplotlib is installed."""
    try:
        import matplotlib
    except ImportError:
        return []
    matplotlib.use("Agg")
    from matplotlib import pyplot

    out = []
    rows = sorted(rows, key=lambda r: r[x])
    for m in metrics:
        fig, ax = pyplot.subplots(figsize=(4.5, 3.0), layout="tight")
        ax.plot([r[x] for r in rows], [r[m] for r in rows], marker="o", markersize=3, linewidth=1.2)
        ax.set(xlabel="Fraction of comparisons (FC)", ylabel=m)
        ax.spines[["top", "right"]].set_visible(False)
        for kind, more in (("eps", {}), ("png", {"dpi": 300})):
            fig.savefig(f"{folder}/{m}_vs_FC.{kind}", **more)
            out.append(f"{folder}/{m}_vs_FC.{kind}")
        pyplot.close(fig)
    return out
