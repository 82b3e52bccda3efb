"""Stores of the feed's state: JSON documents in and out, CSV and HTML exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstream.functions.text import card_body, card_title, escape_html, iso_utc
from quillstream.operators.feed import csv_rows


def load_json(spark: SparkSession, path: str, schema: StructType, seed: DataFrame | None = None) -> DataFrame:
    """Rows of a JSON store. A missing, empty or corrupt store gives the seed rows: one broken row makes it corrupt.

    Whether there are good and broken rows is asked first; rows are read again when they are used, so nothing is cached.
    """
    from pyspark.errors import AnalysisException

    empty = seed if seed is not None else spark.createDataFrame([], schema)
    marked = StructType([*schema.fields]).add("_corrupt_record", "string")
    try:
        rows = spark.read.schema(marked).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
        state = rows.select(schema.names[0], "_corrupt_record").agg(F.count("*").alias("n"), F.count("_corrupt_record").alias("broken"), F.count(schema.names[0]).alias("first")).first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return empty
    return empty if not state["n"] or state["broken"] else spark.read.schema(schema).json(path)


def save_json(posts: DataFrame, path: str, now_ms: int | None = None) -> None:
    """The whole store, written anew, with the time of the writing as `lastUpdated` where it is given."""
    (posts if now_ms is None else posts.withColumn("lastUpdated", F.lit(now_ms))).write.mode("overwrite").json(path)


def merge_state(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; where both have one, every non-null column of the new row wins."""
    names = [c for c in old.columns if c != key]
    n = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in names])
    return old.join(n, key, "full").select(key, *[F.coalesce(f"_new_{c}", c).alias(c) for c in names])


def export_csv(posts: DataFrame, path: str) -> None:
    """The CSV export; every field is quoted and quotation marks are doubled."""
    csv_rows(posts).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


ITEM = ("id", "timestamp", "sourcePlatform", "sourceUrl", "authorName", "authorUrl", "text", "assignedTag", "isFavorite", "isAd")


def json_rows(posts: DataFrame) -> DataFrame:
    """Every post as one JSON document with all its fields, nulls written as null."""
    return posts.select("seq", F.to_json(F.struct(*ITEM), {"ignoreNullFields": "false"}).alias("json"))


def export_json(posts: DataFrame, path: str) -> None:
    """The JSON export: one document a line, in feed order within and between files."""
    json_rows(posts).orderBy(F.desc("seq")).select("json").write.mode("overwrite").text(path)


def html_cards(posts: DataFrame) -> DataFrame:
    """Every post as an HTML fragment of the diary, newest first when sorted by falling `seq`; all text is escaped."""
    e = lambda c: escape_html(F.coalesce(c, F.lit("")))
    html = F.concat(
        F.lit('<article class="card" data-tag="'), e(F.coalesce("assignedTag", F.lit("Unclassified"))), F.lit('"><h3>'), e(card_title(F.col("text"))), F.lit("</h3><p>"), e(card_body(F.col("text"))),
        F.lit('</p><span class="author">'), e(F.col("authorName")), F.lit('</span><a href="'), e(F.col("sourceUrl")), F.lit('">'), e(F.col("sourcePlatform")), F.lit("</a><time>"), F.coalesce(iso_utc(F.col("timestamp")), F.lit("")), F.lit("</time></article>"),
    )
    return posts.select("seq", html.alias("html"))


def search_cards(posts: DataFrame, category: str = "all", words: str = "") -> DataFrame:
    """Posts of the diary under a category whose card, as it is read, contains the words, whatever their case."""
    rows = posts if category == "all" else posts.where(F.coalesce("assignedTag", F.lit("Unclassified")) == category)
    shown = F.concat_ws(" ", F.coalesce("assignedTag", F.lit("Unclassified")), card_title(F.col("text")), card_body(F.col("text")), "authorName", "sourcePlatform")
    return rows.where(F.contains(F.lower(shown), F.lit(words.lower().strip())))


def export_html(posts: DataFrame, path: str) -> None:
    """The diary as text files of fragments, in feed order within and between files."""
    html_cards(posts).orderBy(F.desc("seq")).select("html").write.mode("overwrite").text(path)
