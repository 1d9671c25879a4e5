"""Mixing sources to target weights by a distributed prefix sum of sizes in hash-random order.

Sources by code point (null last) weigh 5, 2, 1, repeating, and share ``share`` times all words; a target stops at
``most`` times its source's words, and what is left over is shared again by weight among the others.

Each row gets a hash-random key; rows are range-sorted by (source, key), every range's words are summed, and the
running sums say in which range, then at which key, a source's budget is used up. Budgets beyond a source's words
take whole epochs first. What a source needs to cut itself is one row, so documents are never shuffled with text.

Rows: texts are counted whole, whatever their length; a null or empty text has size 0 and gives nothing; a null doc_id has a key of its own. Rows that tie on the key
(the same doc_id in the same source) at the cut share what is left in proportion. An empty table gives no rows.
Extra columns are ignored by ``mix`` and kept by ``mixed_documents``, whatever their names. The only table that meets in one task has one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzframe.llm import common

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes: source, source_size, one row per source. Adds target by filling up by weight under the caps: in the order
    of cap over weight, a source is capped while the level that the others would get is above its own."""
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long")
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(fill), F.lit(0))
    level = lambda taken, w: (F.lit(share) * F.col("total") - taken) / (F.col("total_weight") - w)
    rows = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
        .withColumns({"total": F.sum("source_size").over(everything), "total_weight": F.sum("weight").over(everything)})
        .withColumn("capped", F.col("weight") * level(before("cap"), before("weight")) > F.col("cap"))
        .withColumns({f"capped_{c}": F.coalesce(F.sum(F.when(F.col("capped"), F.col(c))).over(everything), F.lit(0)) for c in ("cap", "weight")})
    )
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * level(F.col("capped_cap"), F.col("capped_weight")))
    return rows.select("source", "source_size", target.alias("target"))


def cuts(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """rows: source, key, size. One row per source: source_size, target, epochs (whole ones), cut_key (rows below it are
    taken once more), cut_size and cut_words (how many words of those with just this key are taken once more)."""
    n = common.partitions(rows)
    ranges = rows.select("source", "key", "size").repartitionByRange(n, "source", "key").withColumn("range_no", F.spark_partition_id())
    ranges = common.materialize(ranges, "mix-ranges")
    sums = common.materialize(ranges.groupBy("source", "range_no").agg(F.sum("size").alias("words")), "mix-sums")
    per_source = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    budget = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    per_source = per_source.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    per_source = common.materialize(per_source.withColumn("rest", budget - F.col("epochs") * F.col("source_size")), "mix-targets")
    in_order = Window.partitionBy("source").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    at = sums.withColumn("before", F.coalesce(F.sum("words").over(in_order), F.lit(0))).alias("a").join(per_source.alias("t"), F.col("a.source").eqNullSafe(F.col("t.source")))
    at = at.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest"))).select("t.source", "a.range_no", "before", "rest")
    at = common.materialize(at, "mix-at").alias("c")
    inside = ranges.alias("r").join(at, F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.range_no") == F.col("c.range_no")))
    inside = inside.groupBy("r.source", "r.key", "before", "rest").agg(F.sum("size").alias("cut_size"))
    inside = inside.withColumn("upto", F.col("before") + F.sum("cut_size").over(Window.partitionBy("source").orderBy("key")))
    inside = inside.where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("cut_size") < F.col("rest")))
    cut = inside.select(F.col("source").alias("cut_source"), F.col("key").alias("cut_key"), "cut_size", (F.col("rest") - F.col("upto") + F.col("cut_size")).alias("cut_words"))
    full = per_source.join(cut, F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source", "rest")
    return common.materialize(full, "mix-cuts")


def once_more() -> Column:
    """Words of a row that the last, partial epoch takes; of columns key, size, cut_key, cut_size and cut_words."""
    shared = F.floor(F.col("cut_words") * F.col("size") / F.col("cut_size")).cast("long")
    return F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(F.col("key") == F.col("cut_key"), shared).otherwise(F.lit(0).cast("long"))


def mix(docs: DataFrame, seed: str = SEED, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every document."""
    rows = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), random_key(F.col("doc_id"), seed).alias("key"), words(F.col("text")).alias("size"))
    rows = common.materialize(rows, "mix-sizes")
    cut = cuts(rows, weights, share, most).withColumnRenamed("source", "of")
    joined = rows.join(cut, F.col("source").eqNullSafe(F.col("of")))
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + once_more()).alias("taken"))


def mixed_documents(docs: DataFrame, seed: str = SEED, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself, with the columns of docs: a document once for every epoch that takes all of it, and the document
    at a source's cut with its first words only. Documents of which nothing is taken are left out."""
    names = docs.columns
    rows = docs.select(F.struct(*(docs[c] for c in names)).alias("d")).select(
        "d", F.col("d.source").cast("string").alias("source"), random_key(F.col("d.doc_id"), seed).alias("key"), words(F.col("d.text")).alias("size")
    )
    cut = cuts(rows, weights, share, most).withColumnRenamed("source", "of")
    joined = rows.join(cut, F.col("source").eqNullSafe(F.col("of"))).withColumn("more", once_more())
    whole = F.col("epochs") + (F.col("more") == F.col("size")).cast("long")
    copies = F.when(F.col("size") > 0, whole).otherwise(F.lit(0).cast("long")).cast("int")
    part = F.when((F.col("more") > 0) & (F.col("more") < F.col("size")), F.array(F.col("more"))).otherwise(F.array().cast("array<long>"))
    takes = joined.withColumn("takes", F.concat(F.array_repeat(F.col("size"), copies), part)).select("d", "size", F.explode("takes").alias("take"))
    text = F.when(F.col("take") == F.col("size"), F.col("d.text")).otherwise(_cut_text(F.col("d.text"), F.col("take")))
    cut_row = F.col("take") < F.col("size")
    out = []
    for name in names:
        if name == "text":
            out.append(text.alias("text"))
        elif name == "n_chars":
            out.append(F.when(cut_row, F.length(text)).otherwise(F.col("d.n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            out.append(F.col(f"d.`{name}`").alias(name))
    return takes.select(*out)


def _cut_text(text: Column, n: Column) -> Column:
    """The first n words of text, with the white space before each."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"{common.SPACE}*+{common.WORD}"), F.lit(0)), 1, n.cast("int")), "")
