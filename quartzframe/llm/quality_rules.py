"""Quality rules with cross-document line frequency, in DataFrame expressions only.

1. Every line's normal form (lower case, letters only) is hashed once, into a table of host, text, place and line.
2. A host's distinct documents with a line are counted: distinct whole texts, so copies of a document count once. From
   ``limit`` documents on the line is boilerplate, whatever else stands beside it and however large the host is.
3. The places of boilerplate lines are gathered for each host and text, and each text is taken once more without them.
   A document of which too little is left is depleted and rejected.

Counts have partial sums, so a hot host, line or text is one row a task. Lines meet boilerplate, and texts their places,
by joins; hot lines and texts by a broadcast of at most ten thousand of them (``common.join_counted``). Only texts that
a filter of a fixed size lets pass are shuffled; it decides nothing. The plan is the same at every size.

Rows: a null text has no words and fails; a null host is a host; a null doc_id is kept. Every row is a document, also a
repeated one. Texts are handled whole, whatever their length. An empty table gives no rows. Extra columns are ignored
by ``assess`` and kept by ``cleaned``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzframe.llm import common
from quartzframe.llm.common import let

#: Words in a window, least words of a document, greatest percentage of words in repeated windows.
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
#: Distinct documents of one host from which a line is boilerplate.
LIMIT = 10
#: A document is depleted if fewer words, or a smaller share of its words, are left without boilerplate lines.
LEAST_LEFT = 20
LEAST_LEFT_SHARE = 0.2
SYMBOLS = r"[#*$%&|<>]"


def line_key(line: Column) -> Column:
    """A hash of a line's normal form, null if it has no letter."""
    normal = F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}]+", " "))
    return F.when(normal != "", F.xxhash64(normal))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _keys(source: Column, text: Column) -> dict[str, Column]:
    """host, text_hash and text_length: what only equal texts of one source share, never null."""
    host = F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(""))
    return {"host": host, "text_hash": F.xxhash64(text), "text_length": F.coalesce(F.length(text), F.lit(-1))}


def keyed_lines(docs: DataFrame) -> DataFrame:
    """host, text_hash, text_length, place (from 0) and line (key) of every line with a letter."""
    keys = F.filter(F.transform(lines(F.col("text")), lambda x, i: F.struct(i.alias("place"), line_key(x).alias("line"))), lambda k: k["line"].isNotNull())
    return docs.select(*(c.alias(n) for n, c in _keys(F.col("source"), F.col("text")).items()), F.inline(keys))


def boilerplate(keyed: DataFrame, limit: int = LIMIT) -> DataFrame:
    """host, line, n (rows of keyed) and n_docs (distinct texts) of the lines at or above the limit; keyed: as keyed_lines
    gives them."""
    once = keyed.groupBy("host", "line", "text_hash", "text_length").agg(F.count(F.lit(1)).alias("rows"))
    return once.groupBy("host", "line").agg(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= limit)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of words found twice or more."""

    def covered(windows: Column) -> Column:
        def twice(at: Column) -> Column:
            beside = lambda j: F.get(at, j)["h"]
            marked = F.transform(at, lambda s, j: F.when(s["h"].eqNullSafe(beside(j - 1)) | s["h"].eqNullSafe(beside(j + 1)), s["i"]))
            starts = F.array_sort(F.filter(marked, lambda i: i.isNotNull()))
            empty = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            add = lambda acc, i: F.struct((acc["n"] + i + window - F.greatest(acc["end"], i)).alias("n"), (i + window).alias("end"))
            return F.aggregate(starts, empty, add, lambda acc: acc["n"])

        sorted_windows = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(sorted_windows, twice))

    def hashed(ids: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(ids) - (window - 1))
        windows = F.transform(starts, lambda i: F.xxhash64(F.slice(ids, i, F.lit(window))))
        return F.when(F.size(ids) > window, let(windows, covered)).otherwise(0)

    return let(F.transform(words, lambda w: F.xxhash64(w)), hashed).cast("long")


def with_boilerplate(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """docs (text, source and others) and the places of its boilerplate lines as ``boilerplate_places``, null if it has none."""
    keyed = common.materialize(keyed_lines(docs), "lines")
    found = common.materialize(boilerplate(keyed, limit).select("host", "line", "n"), "boilerplate")
    keys = ["host", "text_hash", "text_length"]
    places = common.join_counted(keyed, found, ["host", "line"]).groupBy(*keys).agg(F.collect_set("place").alias("boilerplate_places"), F.count(F.lit(1)).alias("rows"))
    # each row of a text has every place once
    places = common.materialize(places.withColumn("n", F.floor(F.col("rows") / F.size("boilerplate_places"))).drop("rows"), "places")
    return common.join_filtered(docs.withColumns(_keys(docs["source"], docs["text"])), places, keys, "left").drop(*keys)


def _left_lines(text: Column, places: Column) -> Column:
    """The lines of text without those at places."""
    return let(lines(text), lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), places), lambda i: F.get(x, i)))


def _figures(text: Column, places: Column) -> Column:
    """The figures of one row as a struct; places: of its boilerplate lines, or null."""
    text = F.coalesce(text, F.lit(""))
    filled = F.filter(lines(text), lambda line: line.rlike(common.WORD))
    left = F.regexp_count(F.array_join(_left_lines(text, places), "\n"), F.lit(common.WORD)).cast("long")

    def of(words: Column) -> Column:
        n = F.size(words).cast("long")
        return F.struct(
            n.alias("n_words"),
            F.length(F.regexp_replace(text, f"{common.SPACE}+", "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            let(filled, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            F.when(places.isNull(), n).otherwise(left).alias("n_left_words"),
        )

    return let(F.regexp_extract_all(text, F.lit(common.WORD), F.lit(0)), of)


def _verdict(df: DataFrame) -> DataFrame:
    """df: a struct of figures, named figures, and others. Adds base_failed and kept."""
    f = lambda c: F.col(f"figures.{c}")
    failed = (f("n_words") < LEAST_WORDS) | (100 * f("n_repeat_words") > MOST_REPEATED * f("n_words"))
    depleted = (f("n_left_words") < LEAST_LEFT) | (f("n_left_words") < LEAST_LEFT_SHARE * f("n_words"))
    return df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~depleted)


def assess(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_left_words, base_failed and kept of every row."""
    rows = with_boilerplate(docs.select("doc_id", "source", "text"), limit)
    return _verdict(rows.select("doc_id", _figures(F.col("text"), F.col("boilerplate_places")).alias("figures"))).select("doc_id", "figures.*", "base_failed", "kept")


def cleaned(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The rows of docs that are kept, without their boilerplate lines; n_chars, if there, follows the text."""
    names = docs.columns
    rows = docs.select("text", "source", F.struct(*(docs[c] for c in names)).alias("d"))
    rows = with_boilerplate(rows, limit)
    rows = _verdict(rows.select("d", "boilerplate_places", _figures(F.col("text"), F.col("boilerplate_places")).alias("figures"))).where("kept")
    text = F.when(F.col("boilerplate_places").isNull(), F.col("d.text")).otherwise(F.array_join(_left_lines(F.col("d.text"), F.col("boilerplate_places")), "\n"))
    rows = rows.select("d", text.alias("new_text"))
    chars = lambda c: F.when(F.col("new_text") == F.col("d.text"), F.col("d.n_chars")).otherwise(F.length("new_text")).cast(docs.schema[c].dataType)
    made = {"text": lambda c: F.col("new_text"), "n_chars": chars}
    return rows.select(*(made.get(c, lambda c: F.col("d")[c])(c).alias(c) for c in names))
