"""The feed as Structured Streaming: ingestion in micro-batches, dedup and upsert by URL, incremental counts, idle retry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from quillstream.operators.classify import classify
from quillstream.operators.state import JOINT


def read_posts(spark: SparkSession, path: str, schema: StructType, files: int = 100, only: str = "*.parquet") -> DataFrame:
    """Posts of a folder of parquet files as a stream, a bounded number of files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", only).parquet(path)


def ingest(posts: DataFrame, tags: list, late: str = "10 days") -> DataFrame:
    """Posts with a text, once each within the watermark, classified. Works on streams and on tables."""
    seen = posts.where("text is not null")
    if posts.isStreaming:
        seen = seen.withWatermark("receivedAt", late).dropDuplicatesWithinWatermark(["text"])
    else:
        seen = seen.dropDuplicates(["text"])
    return classify(seen, tags)


def counts_by_tag(posts: DataFrame, window: str = "1 day", late: str = "10 days") -> DataFrame:
    """Posts by tag and window of arrival; late rows count until the watermark passes them."""
    rows = posts.withWatermark("receivedAt", late) if posts.isStreaming else posts
    return rows.groupBy(F.window("receivedAt", window).alias("w"), F.coalesce("assignedTag", F.lit("Unclassified")).alias("tag")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "tag", "n")


def bursts(posts: DataFrame, gap: str = "5 minutes") -> DataFrame:
    """Bursts of arrivals: posts whose arrivals are less than `gap` apart, as (start, end, n)."""
    rows = posts.withWatermark("receivedAt", "1 day") if posts.isStreaming else posts
    return rows.groupBy(F.session_window("receivedAt", gap).alias("w"), "sourcePlatform").agg(F.count("*").alias("n")).select("sourcePlatform", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def upserts(posts: DataFrame) -> DataFrame:
    """Stream of the merged row of each URL after every batch: state is the merged text with its newest `seq`."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, seq, n = state.get if state.exists else ("", -1, 0)
        # arrival order within a micro-batch; what has been merged before stays
        rows = pd.concat(list(batches)).sort_values("seq")
        for s, t in zip(rows["seq"], rows["text"]):
            t = t if isinstance(t, str) else ""
            if not n:
                text, seq, n = t, int(s), 1
            elif t not in text:
                text, seq, n = text + JOINT + t, int(s), n + 1
        state.update((text, seq, n))
        yield pd.DataFrame([(key[0], text, seq, n)], columns=["sourceUrl", "text", "seq", "n_texts"])

    keyed = posts.where(F.col("sourceUrl").rlike("^https?://")).select("sourceUrl", "seq", "text")
    kinds = "sourceUrl string, text string, seq long, n_texts long"
    return keyed.groupBy("sourceUrl").applyInPandasWithState(step, kinds, "text string, seq long, n long", "update", GroupStateTimeout.NoTimeout)


def reclassify(posts: DataFrame, tags: list, n: int | None = 5) -> DataFrame:
    """The newest unclassified posts classified anew; `n` a round, all of them with None."""
    rows = posts.where(F.coalesce("assignedTag", F.lit("Unclassified")) == "Unclassified")
    return classify(rows if n is None else rows.orderBy(F.desc("seq")).limit(n), tags)


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """All that is available now through `foreachBatch`, with a checkpoint, so that a restart goes on where it stopped."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
