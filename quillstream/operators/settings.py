"""Changes of the configuration: tags, sites, keywords and ignore rules added, removed and switched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def after_changes(rows: DataFrame, changes: DataFrame, key: tuple[str, ...], flag: str = "isEnabled", folded: bool = False) -> DataFrame:
    """Configuration rows (key, flag) after changes (key, op, at), in the order of `at`.

    `op` is add, remove or toggle. An add of what is there changes nothing, one of what isn't brings it enabled; a remove of
    what isn't there and a toggle of it change nothing. The last add or remove tells whether a row is there; if the row
    was there all along, its flag goes on from the stored one, else from true, and each later toggle flips it. `folded`
    compares keys whatever their case and keeps the stored spelling, or that of the first add. Null keys are dropped.
    Whatever the number of changes, each key is one row of aggregates.
    """
    low = lambda c: F.lower(c) if folded else F.col(c)
    known = rows.dropna(subset=list(key)).select(*[low(k).alias(f"_{k}") for k in key], *key, F.coalesce(flag, F.lit(False)).alias("_was"), F.lit(True).alias("_there"))
    events = changes.dropna(subset=list(key)).select(*[low(k).alias(f"_{k}") for k in key], *[F.col(k).alias(f"_new_{k}") for k in key], "op", "at")
    keys = [f"_{k}" for k in key]
    each = events.groupBy(*keys).agg(
        F.max(F.when(F.col("op") == "remove", F.col("at"))).alias("_removed"),
        F.sort_array(F.collect_list(F.when(F.col("op") != "toggle", F.struct("at", "op")))).alias("_ops"),
        F.sort_array(F.collect_list(F.when(F.col("op") == "toggle", F.col("at")))).alias("_toggles"),
        *[F.min_by(f"_new_{k}", F.when(F.col("op") == "add", F.col("at"))).alias(f"_new_{k}") for k in key],
    )
    both = known.join(each, keys, "full").withColumn("_there", F.coalesce("_there", F.lit(False))).withColumn("_ops", F.coalesce("_ops", F.array().cast("array<struct<at:bigint,op:string>>"))).withColumn("_toggles", F.coalesce("_toggles", F.array().cast("array<bigint>")))
    # an add brings something only where nothing was: first of all, or after a remove
    since = F.aggregate(
        F.col("_ops"), F.struct(F.col("_there").alias("on"), F.lit(None).cast("bigint").alias("at")),
        lambda s, x: F.when((x["op"] == "add") & ~s["on"], F.struct(F.lit(True).alias("on"), x["at"].cast("bigint").alias("at"))).when(x["op"] == "remove", F.struct(F.lit(False).alias("on"), F.lit(None).cast("bigint").alias("at"))).otherwise(s),
    )
    both = both.withColumn("_now", since)
    start = F.when(F.col("_now.at").isNull(), F.col("_was")).otherwise(F.lit(True))
    flips = F.size(F.filter("_toggles", lambda t: F.col("_now.at").isNull() | (t > F.col("_now.at")))) % 2 == 1
    return both.where("_now.on").select(*[F.coalesce(k, f"_new_{k}").alias(k) for k in key], (start != flips).alias(flag))
