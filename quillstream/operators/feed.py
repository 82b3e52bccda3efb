"""Filters, facets, rankings and ordered views of the feed. Rows come as a table of posts; `seq` is the arrival order,
and newest first means falling `seq`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.session import broadcast_if_small

#: First row of the feed by a key is the one with the greatest `seq`; "latest" is its timestamp, not the greatest one.
def latest() -> Column:
    """Timestamp of the first row of the feed."""
    return F.max_by("timestamp", "seq")


def host(col: Column) -> Column:
    """Platform in lower case without blanks and `www.`; the former name of x.com counts as x.com."""
    h = F.regexp_replace(F.lower(F.trim(col)), "^www\\.", "")
    return F.when(h == "twitter.com", F.lit("x.com")).otherwise(h)


def under(h: Column, domain: Column) -> Column:
    """Is the host the domain or one below it?"""
    d = F.lower(domain)
    return (h == d) | h.endswith(F.concat(F.lit("."), d))


def with_site(posts: DataFrame, sites: DataFrame) -> DataFrame:
    """`posts` with `site`: the first enabled site, by `pos`, that the platform is under, else `Other`.

    Distinct hosts meet the sites first, so the rows themselves join on equality; null platforms are `Other`.
    """
    hosts = posts.select(host(F.col("sourcePlatform")).alias("_host")).where("_host is not null").distinct()
    real = broadcast_if_small(sites.where("isEnabled and domain <> '*'").select(F.col("domain").alias("_domain"), F.col("pos").alias("_pos")))
    of = hosts.join(real, under(F.col("_host"), F.col("_domain"))).groupBy("_host").agg(F.min_by("_domain", "_pos").alias("site"))
    return posts.withColumn("_host", host(F.col("sourcePlatform"))).join(of, "_host", "left").withColumn("site", F.coalesce("site", F.lit("Other"))).drop("_host")


def site_enabled(posts: DataFrame, sites: DataFrame) -> DataFrame:
    """Posts of enabled sites: all if the wildcard is enabled, else those whose first matching site is."""
    hosts = posts.select(host(F.col("sourcePlatform")).alias("_host")).where("_host is not null").distinct()
    rows = broadcast_if_small(sites.select("domain", "isEnabled", "pos"))
    first = hosts.join(rows.where("domain <> '*'"), under(F.col("_host"), F.col("domain"))).groupBy("_host").agg(F.min_by("isEnabled", "pos").alias("_on"))
    wild = rows.where("domain = '*'").agg(F.coalesce(F.max("isEnabled"), F.lit(False)).alias("_all"))
    out = posts.withColumn("_host", host(F.col("sourcePlatform"))).join(first, "_host", "left").crossJoin(F.broadcast(wild))  # one row
    return out.where("_all or coalesce(_on, false)").drop("_host", "_on", "_all")


def rule(rules: DataFrame, kind: str) -> DataFrame:
    """The values of one kind of ignore rules."""
    return broadcast_if_small(rules.where(F.col("kind") == kind).select(F.col("value").alias("_value")).distinct())


def without_ignored(posts: DataFrame, rules: DataFrame, keywords: bool = True) -> DataFrame:
    """Posts that no ignore rule drops: keywords in the text (not for stored posts), links, domains and tags."""
    out = posts
    kinds = {
        "keyword": lambda p, v: F.contains(F.lower(p["text"]), F.lower(v)),
        "link": lambda p, v: p["sourceUrl"] == v,
        "domain": lambda p, v: under(host(p["sourcePlatform"]), v),
        "tag": lambda p, v: F.lower(p["assignedTag"]) == F.lower(v),
    }
    for kind, drops in kinds.items():
        if kind != "keyword" or keywords:
            r = rule(rules, kind)
            out = out.join(r, drops(out, r["_value"]), "left_anti")
    return out


def by_tag(posts: DataFrame, tag: str | None) -> DataFrame:
    """Posts of a tag; All or null means all, Favorites and Ads are facets of their own."""
    if tag in (None, "All"):
        return posts
    if tag == "Favorites":
        return posts.where("coalesce(isFavorite, false)")
    if tag == "Ads":
        return posts.where("coalesce(isAd, false)")
    return posts.where(F.coalesce("assignedTag", F.lit("Unclassified")) == tag)


def search(posts: DataFrame, query: str, columns: tuple[str, ...] = ("assignedTag", "text", "authorName", "sourcePlatform")) -> DataFrame:
    """Posts of which a column contains the query, whatever its case."""
    q = F.lit(query.lower().strip())
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), q), F.lit(False))
    return posts.where(hit)


def category_facets(posts: DataFrame) -> DataFrame:
    """Rows (facet, n): All, Favorites, Ads and every tag. One scan, one small shuffle."""
    facets = F.filter(F.array(F.lit("All"), F.when(F.col("isFavorite"), F.lit("Favorites")), F.when(F.col("isAd"), F.lit("Ads")), F.coalesce("assignedTag", F.lit("Unclassified"))), lambda x: x.isNotNull())
    return posts.select(F.explode(facets).alias("facet")).groupBy("facet").agg(F.count("*").alias("n"))


def tag_order(posts: DataFrame, tags: DataFrame) -> DataFrame:
    """Tags in the order of their latest posts; ties and tags without posts keep the order of the configuration."""
    newest = posts.groupBy(F.col("assignedTag").alias("label")).agg(latest().alias("latest"))
    out = tags.join(broadcast_if_small(newest), "label", "left").select("label", "pos", F.coalesce("latest", F.lit(0)).alias("latest"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("latest"), "pos", "label")))


def tag_tabs(posts: DataFrame, tags: DataFrame) -> DataFrame:
    """The tabs of the feed with their counts: All and Favorites, the enabled tags by recency, Ads and Unclassified."""
    real = tag_order(posts, tags.where("isEnabled and label not in ('Ads', 'Unclassified')")).select("label", F.lit(1).alias("part"), "place")
    pinned = tags.sparkSession.createDataFrame([("All", 0, 0), ("Favorites", 0, 1), ("Ads", 2, 0), ("Unclassified", 2, 1)], "label string, part int, place int")
    n = category_facets(posts).withColumnRenamed("facet", "label")
    order = F.row_number().over(Window.orderBy("part", "place"))  # one row a tag
    return pinned.unionByName(real).join(broadcast_if_small(n), "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"), (order - 1).alias("place"))


def site_tabs(posts: DataFrame, sites: DataFrame) -> DataFrame:
    """The sites of the feed with their counts: All, the enabled sites by recency, and Other last if it has posts."""
    by = with_site(posts, sites).groupBy("site").agg(F.count("*").alias("n"), latest().alias("latest"))
    real = sites.where("isEnabled and domain <> '*'").select(F.col("domain").alias("site"), "pos")
    each = real.join(broadcast_if_small(by), "site", "left").select("site", F.lit(1).alias("part"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("latest", F.lit(0)).alias("latest"), "pos")
    other = by.where("site = 'Other'").select("site", F.lit(2).alias("part"), "n", F.lit(0).cast("long").alias("latest"), F.lit(0).alias("pos"))
    every = posts.agg(F.count("*").alias("n")).select(F.lit("All").alias("site"), F.lit(0).alias("part"), "n", F.lit(0).cast("long").alias("latest"), F.lit(0).alias("pos"))
    order = F.row_number().over(Window.orderBy("part", F.desc("latest"), "pos", "site"))  # one row a site
    return every.unionByName(each).unionByName(other).select("site", "n", (order - 1).alias("place"))


def tab_site(hosts: DataFrame, sites: DataFrame, column: str = "host") -> DataFrame:
    """`hosts` with `site`: the first site, by `pos`, that the host of a browser tab is under, if it is enabled; else All."""
    each = hosts.select(host(F.col(column)).alias("_host")).where("_host is not null").distinct()
    real = broadcast_if_small(sites.where("domain <> '*'").select("domain", "isEnabled", "pos"))
    of = each.join(real, under(F.col("_host"), F.col("domain"))).groupBy("_host").agg(F.min_by(F.when(F.col("isEnabled"), F.col("domain")), "pos").alias("site"))
    return hosts.withColumn("_host", host(F.col(column))).join(of, "_host", "left").withColumn("site", F.coalesce("site", F.lit("All"))).drop("_host")


def by_author(posts: DataFrame, name: str, column: str = "authorName") -> DataFrame:
    """Posts of one author, by the canonical name where `column` holds it; case counts."""
    return posts.where(F.col(column) == name)


def tracked(posts: DataFrame, tags: DataFrame) -> DataFrame:
    """`posts` with `label`, the configured tag of the same name whatever its case, and `isTracked`, whether that one is enabled."""
    few = broadcast_if_small(tags.groupBy(F.lower("label").alias("_tag")).agg(F.min_by("label", "pos").alias("label"), F.min_by("isEnabled", "pos").alias("isTracked")))
    return posts.join(few, F.lower("assignedTag") == F.col("_tag"), "left").drop("_tag").withColumn("isTracked", F.coalesce("isTracked", F.lit(False)))


def unless_paused(posts: DataFrame, paused: bool) -> DataFrame:
    """Nothing comes in while tracking is paused."""
    return posts.where(F.lit(not paused))


def without_values(rules: DataFrame, removed: DataFrame) -> DataFrame:
    """Ignore rules without the removed ones (kind, value): keywords and links by their exact value, tags and domains
    whatever their case."""
    folded = lambda c: F.when(F.col("kind").isin("tag", "domain"), F.lower(c)).otherwise(F.col(c))
    gone = removed.select("kind", folded("value").alias("_value")).distinct()
    return rules.withColumn("_value", folded("value")).join(broadcast_if_small(gone), ["kind", "_value"], "left_anti").drop("_value")


def percentages(counts: DataFrame, key: str) -> DataFrame:
    """Counts as shares of the greatest one, in whole percent; zero counts are left out."""
    top = F.broadcast(counts.agg(F.max("n").alias("_top")))  # one row
    return counts.where("n > 0").crossJoin(top).select(key, "n", F.floor(100 * F.col("n") / F.greatest("_top", F.lit(1)) + 0.5).cast("long").alias("pct"))


def top_authors(posts: DataFrame, n: int = 10, active: str | None = None, column: str = "authorName") -> DataFrame:
    """The authors of most posts; ties go to the one that came first. The active author is added if it isn't among them."""
    name = F.nullif(F.trim(column), F.lit(""))
    counts = posts.select(name.alias("author"), "seq").where("author is not null").groupBy("author").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    top = counts.orderBy(F.desc("n"), "first_seq").limit(n)
    return top if active is None else top.unionByName(counts.where(F.col("author") == active)).distinct()


def first_by_author(posts: DataFrame) -> DataFrame:
    """The newest post of every author."""
    name = F.nullif(F.trim("authorName"), F.lit(""))
    return posts.withColumn("author", name).where("author is not null").groupBy("author").agg(F.max("seq").alias("seq"), latest().alias("timestamp"))


#: Rows of one range of `seq`, and ranges of one range of ranges.
RANGE = 4096


def _ranged(rows: DataFrame) -> DataFrame:
    return rows.withColumn("block", F.floor(F.col("seq") / RANGE)).withColumn("far", F.floor(F.col("block") / RANGE))


def day_separators(posts: DataFrame, now_ms: int, zone: str = "UTC") -> DataFrame:
    """Rows of the feed that a day label precedes: the day differs from that of the row before, newest first.

    Labels are Today, Yesterday or the date, in the time zone `zone`. The order is global: days are cut within ranges of
    `seq`, only the borders of ranges meet within ranges of ranges, and only the borders of these meet in one task: one row
    for 16 million.
    """
    local = lambda ms: F.to_date(F.from_utc_timestamp(F.timestamp_millis(ms), zone))
    today = local(F.lit(now_ms))
    rows = _ranged(posts.select("seq", local(F.col("timestamp")).alias("day")))
    inside = Window.partitionBy("block").orderBy(F.desc("seq"))
    rows = rows.withColumn("before", F.lag("day").over(inside)).withColumn("first", F.row_number().over(inside) == 1)
    last = rows.groupBy("far", "block").agg(F.min_by("day", "seq").alias("last_day"))
    within = Window.partitionBy("far").orderBy(F.desc("block"))
    borders = last.select("far", "block", F.lag("last_day").over(within).alias("above"), (F.row_number().over(within) == 1).alias("edge"))
    far = last.groupBy("far").agg(F.min_by("last_day", "block").alias("far_day")).select("far", F.lag("far_day").over(Window.orderBy(F.desc("far"))).alias("beyond"))
    above = borders.join(far, "far").select("block", F.when(F.col("edge"), F.col("beyond")).otherwise(F.col("above")).alias("above"))
    rows = rows.join(above, "block").withColumn("before", F.when(F.col("first"), F.col("above")).otherwise(F.col("before")))
    label = F.when(F.col("day") == today, "Today").when(F.col("day") == F.date_sub(today, 1), "Yesterday").otherwise(F.date_format("day", "yyyy-MM-dd"))
    return rows.where(F.col("before").isNull() | (F.col("before") != F.col("day"))).select("seq", label.alias("label"))


def positions(posts: DataFrame) -> DataFrame:
    """Place of every post in the view, newest first, from 0: counts of ranges of ranges, of ranges, and the place within one."""
    rows = _ranged(posts.select("seq"))
    sizes = rows.groupBy("far", "block").agg(F.count("*").alias("k"))
    above = lambda w: F.coalesce(F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = sizes.select("far", "block", above(Window.partitionBy("far").orderBy(F.desc("block"))).alias("near"))
    far = sizes.groupBy("far").agg(F.sum("k").alias("k")).select("far", above(Window.orderBy(F.desc("far"))).alias("beyond"))
    place = F.row_number().over(Window.partitionBy("block").orderBy(F.desc("seq"))) - 1
    offsets = near.join(far, "far").select("block", (F.col("near") + F.col("beyond")).alias("offset"))
    return rows.withColumn("place", place).join(offsets, "block").select("seq", (F.col("place") + F.col("offset")).cast("long").alias("position"))


def next_tags(tags: DataFrame) -> DataFrame:
    """Next and previous tag of every enabled tag and Unclassified, round about; Ads is left out."""
    rows = tags.where("isEnabled and label <> 'Ads'").select("label", "pos").unionByName(tags.sparkSession.createDataFrame([("Unclassified", 1 << 30)], "label string, pos int"))
    w, ends = Window.orderBy("pos", "label"), Window.orderBy("pos", "label").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select("label", F.coalesce(F.lead("label").over(w), F.first("label").over(ends)).alias("next"), F.coalesce(F.lag("label").over(w), F.last("label").over(ends)).alias("previous"))


def cleared(posts: DataFrame, tag: str) -> DataFrame:
    """What stays when a tag is cleared: other posts and favourites."""
    hit = F.lit(True) if tag == "All" else F.coalesce("isAd", F.lit(False)) if tag == "Ads" else F.coalesce("assignedTag", F.lit("Unclassified")) == tag
    return posts.where(~hit | F.coalesce("isFavorite", F.lit(False)))


def after_mutations(posts: DataFrame, actions: DataFrame) -> DataFrame:
    """Posts with all user actions applied: toggled favourites, the last new tag, deleted posts gone.

    A repeated action counts once by its id. An odd number of toggles flips the favourite. Null tags change nothing.
    """
    a = actions.where("seq is not null").dropDuplicates(["actionId"])
    sums = a.groupBy("seq").agg(
        F.count_if(F.col("kind") == "FAVORITE_TOGGLED").alias("_toggles"),
        F.max_by(F.when(F.col("kind") == "ITEM_RETAGGED", F.col("newTag")), F.when((F.col("kind") == "ITEM_RETAGGED") & F.col("newTag").isNotNull(), F.struct("actedAt", "actionId"))).alias("_tag"),
        F.max(F.col("kind") == "ITEM_DELETED").alias("_gone"),
    )
    out = posts.join(sums, "seq", "left").where("not coalesce(_gone, false)")
    flipped = F.coalesce(F.col("_toggles") % 2 == 1, F.lit(False))
    return out.withColumn("isFavorite", F.coalesce("isFavorite", F.lit(False)) != flipped).withColumn("assignedTag", F.coalesce("_tag", "assignedTag")).drop("_toggles", "_tag", "_gone")


def dedup(posts: DataFrame) -> DataFrame:
    """One row per text, the first that came; rows without a text stay. Long texts meet by hash and are compared whole."""
    some = posts.where("text is not null").groupBy(F.xxhash64("text").alias("_h"), "text").agg(F.min("seq").alias("seq")).select("seq")
    return posts.where("text is null").unionByName(posts.join(some, "seq", "left_semi"))


def csv_rows(posts: DataFrame) -> DataFrame:
    """The nine columns of the CSV export as text."""
    from quillstream.functions.text import iso_utc

    flag = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), F.lit("TRUE")).otherwise(F.lit("FALSE"))
    text = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d))
    return posts.select(text("id", "").alias("id"), F.coalesce(iso_utc(F.col("timestamp")), F.lit("")).alias("time"), text("sourcePlatform", "unknown").alias("platform"), text("authorName", "").alias("author"), text("authorUrl", "").alias("author_url"), text("sourceUrl", "").alias("url"), text("assignedTag", "Unclassified").alias("tag"), flag("isFavorite").alias("favorite"), text("text", "").alias("text"))
