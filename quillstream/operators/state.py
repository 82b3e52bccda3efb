"""Order-dependent operators: merging posts of one URL, and naming of dynamic tags."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of one URL are joined with an empty line between.
JOINT = "\n\n"


def merge_texts(texts: list[str | None]) -> tuple[str, int]:
    """Texts in order of arrival as one; a text that the whole already contains adds nothing. Also the merges made."""
    out, merged = "", 0
    for k, t in enumerate(texts):
        t = t or ""
        if k == 0:
            out = t
        elif t not in out:
            out, merged = out + JOINT + t, merged + 1
    return out, merged


def upsert_by_url(posts: DataFrame) -> DataFrame:
    """One row per http(s) URL: texts merged in order of arrival, `seq` of the last merge (it moves the post to the top),
    the first timestamp and favourite, isAd if any post has it. Posts without such a URL stay as they are.

    A URL with one different text is settled by aggregates; only the others are folded, each text once and in the order of
    its first arrival, so what reaches a fold is bounded by the different texts of one URL, not by its posts. A null text
    counts as an empty one.
    """
    http = F.coalesce(F.col("sourceUrl").rlike("^https?://"), F.lit(False))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    keyed = posts.where(http).select("sourceUrl", F.coalesce("text", F.lit("")).alias("text"), "seq", "timestamp", flag("isAd").alias("isAd"), flag("isFavorite").alias("isFavorite"))
    first = keyed.groupBy("sourceUrl", "text").agg(F.min("seq").alias("seq"), F.min_by("timestamp", "seq").alias("timestamp"), F.max("isAd").alias("isAd"), F.min_by("isFavorite", "seq").alias("isFavorite"))
    by_url = first.groupBy("sourceUrl").agg(
        F.count("*").alias("n_texts"), F.min("seq").alias("seq"), F.min_by("timestamp", "seq").alias("timestamp"), F.max("isAd").alias("isAd"), F.min_by("isFavorite", "seq").alias("isFavorite"), F.min_by("text", "seq").alias("text"),
    )
    columns = ["sourceUrl", "seq", "text", "timestamp", "isAd", "isFavorite", "n_texts"]
    several = by_url.where("n_texts > 1")

    def fold(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("seq")
        out, seq = "", int(b["seq"].iloc[0])
        for k, (s, t) in enumerate(zip(b["seq"], b["text"])):
            if k == 0:
                out = t
            elif t not in out:
                out, seq = out + JOINT + t, int(s)
        return pd.DataFrame([(b["sourceUrl"].iloc[0], seq, out)], columns=["sourceUrl", "seq", "text"])

    folded = first.join(several.select("sourceUrl"), "sourceUrl", "left_semi").select("sourceUrl", "seq", "text").groupBy("sourceUrl").applyInPandas(fold, "sourceUrl string, seq long, text string")
    merged = several.drop("seq", "text").join(folded, "sourceUrl").select(columns)
    alone = posts.where(~http).select("sourceUrl", "seq", "text", "timestamp", flag("isAd").alias("isAd"), flag("isFavorite").alias("isFavorite"), F.lit(1).cast("long").alias("n_texts"))
    return by_url.where("n_texts = 1").select(columns).unionByName(merged).unionByName(alone)


def dynamic_tags(posts: DataFrame, topic: str, limit: int = 10) -> DataFrame:
    """The topics that become dynamic tags: the first `limit` different ones in order of arrival.

    Only each topic's first arrival is sorted, and the limit is pushed into the sort.
    """
    first = posts.where(F.col(topic).isNotNull()).groupBy(F.lower(topic).alias("key")).agg(F.min("seq").alias("seq"), F.min_by(topic, "seq").alias("label"))
    return first.orderBy("seq").limit(limit).select("label", "seq")
