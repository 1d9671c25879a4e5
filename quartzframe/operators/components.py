"""Connected components of group and near-duplicate edges, and what grouped folds need of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quartzframe.plans import tables


def connected_components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """nodes: node; edges: a, b. node, component (the least node that it reaches). Alternating large-star and small-star
    rounds, each a table in the shared folder, until one changes nothing."""
    order = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    known = tables.materialize(edges.where("a <> b").select(*order).distinct(), "edges")

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = state(known)
    for _ in range(rounds):
        if not now[0]:
            break
        both = known.union(known.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        known = tables.materialize(small.where("u <> v").distinct(), "edges")
        was, now = now, state(known)
        if was == now:
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.select("node").distinct().join(known, F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("component"))


def star_edges(members: DataFrame, group: str, member: str) -> DataFrame:
    """Edges a, b from each group's least member to its others: as connected as all pairs, without them."""
    least = members.groupBy(group).agg(F.min(member).alias("a"))
    return members.join(least, group).where(F.col(member) != F.col("a")).select("a", F.col(member).alias("b"))


def assign_groups(items: DataFrame, base_group: str, clusters: DataFrame | None = None, reliable: bool = True) -> DataFrame:
    """items: item and its base group; clusters: cluster, item. item, component: items of one base group or one
    near-duplicate cluster are together; clusters of an unreliable detector are left out."""
    edges = star_edges(items.where(F.col(base_group).isNotNull()), base_group, "item")
    if clusters is not None and reliable:
        present = clusters.join(items.select("item"), "item", "left_semi")
        edges = edges.union(star_edges(present, "cluster", "item"))
    return connected_components(items.select(F.col("item").alias("node")), edges).withColumnRenamed("node", "item")


def spanning_clusters(items: DataFrame, base_group: str, clusters: DataFrame) -> DataFrame:
    """Clusters whose members come from more than one base group."""
    return clusters.join(items, "item").groupBy("cluster").agg(F.count_distinct(base_group).alias("n_groups")).where("n_groups > 1")


def group_sizes(groups: DataFrame, group: str = "component") -> DataFrame:
    """n_items, n_groups, least, upper middle and greatest size, and whether groups are nearly items."""
    sizes = groups.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.sum("n").alias("n_items"), F.count(F.lit(1)).alias("n_groups"), F.min("n").alias("min_size"), F.max("n").alias("max_size"))
    counted = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    w = Window.orderBy("n")
    # one row for each distinct size
    placed = counted.withColumns({"upto": F.sum("m").over(w), "total": F.sum("m").over(Window.partitionBy(F.lit(0)))})
    middle = placed.where((F.col("upto") > F.floor(F.col("total") / 2)) & (F.col("upto") - F.col("m") <= F.floor(F.col("total") / 2))).select(F.col("n").alias("median_size"))
    return row.join(middle, F.lit(True)).withColumn("per_item_like", F.col("n_groups") >= 0.95 * F.col("n_items"))
