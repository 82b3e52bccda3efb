"""Queries of the feed over the tables of a folder, each with its SQL twin where SQL can express it.

All run over whole tables. The clock is a parameter: the newest timestamp of the data stands for now.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.config import STOP_WORDS, Tag, significant_keywords, significant_phrases, tag_keywords
from quillstream.functions import text as T
from quillstream.operators import authors as A
from quillstream.operators import classify as C
from quillstream.operators import feed as O
from quillstream.operators import state as S
from quillstream.operators.settings import after_changes
from quillstream.session import read_table
from quillstream.sources import pages, stores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW_MS = 1_767_225_600_000  # a fixed clock: 2026-01-01 in UTC
PROMPT = 'the "yield curve" or bank mergers and dividend news'
#: Tags of the flagship query; the driver's table of tags has these labels.
LABELS = ("Lab & Field", "Courts", "Matches", "Code", "Wellbeing", "Money", "Kitchen", "On The Road", "Stage & Sound", "Sky Watch", "Opinion Corner", "Announcements", "Local Notices", "Showcase")
PROMPTS = {label: f"Posts about {label.lower()}" for label in LABELS[:10]}
TAGS = [Tag(label, PROMPTS.get(label), k) for k, label in enumerate(LABELS)]

HOST = r"CASE WHEN regexp_replace(lower(trim(sourcePlatform)), '^www\.', '') = 'twitter.com' THEN 'x.com' ELSE regexp_replace(lower(trim(sourcePlatform)), '^www\.', '') END"
TAG = "coalesce(assignedTag, 'Unclassified')"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def stack(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "stack")


def table(name: str):
    return lambda spark, d: read_table(spark, d, name)


# --- text ---------------------------------------------------------------------------------------------------------
# Formats of what is masked, as the twins write them.
CARD, PHONE, EMAIL = r"\b(?:\d[ -]*?){13,19}\b", r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b|\+\d{1,3}\s\d{3}\s\d{4}\s\d{4}", r"\b[\w.-]+@[\w.-]+\.\w{2,}\b"
LUHN = "list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(d[len(d) - i + 1] AS INT) WHEN CAST(d[len(d) - i + 1] AS INT) > 4 THEN 2 * CAST(d[len(d) - i + 1] AS INT) - 9 ELSE 2 * CAST(d[len(d) - i + 1] AS INT) END)) % 10 = 0"


_CLEAN = f"""m AS (SELECT seq, unnest(regexp_extract_all(text, '{CARD}')) AS c FROM stack),
    v AS (SELECT seq, c, regexp_replace(c, '[^0-9]', '', 'g') AS d FROM m),
    good AS (SELECT seq, list(DISTINCT c) AS cards FROM v WHERE len(d) BETWEEN 13 AND 19 AND {LUHN} GROUP BY seq),
    masked AS (SELECT s.seq, s.text, regexp_replace(regexp_replace(list_reduce(list_concat([s.text], coalesce(cards, CAST([] AS VARCHAR[]))), lambda a, c: replace(a, c, '[REDACTED_CC]')), '{PHONE}', '[REDACTED_PHONE]', 'g'), '{EMAIL}', '[REDACTED_EMAIL]', 'g') AS clean
    FROM stack s LEFT JOIN good g ON s.seq = g.seq WHERE s.text IS NOT NULL)"""


@query(f"WITH {_CLEAN} SELECT seq, clean FROM masked")
def sanitized_posts(spark, d):
    """C1 over all posts."""
    return stack(spark, d).where("text is not null").select("seq", T.sanitize(F.col("text")).alias("clean"))


@query(f"SELECT {HOST} AS platform, count(*) AS n FROM stack WHERE length(text) BETWEEN 60 AND 2000 GROUP BY 1")
def length_filter(spark, d):
    """X8 by platform."""
    return stack(spark, d).where(F.length("text").between(60, 2000)).groupBy(O.host(F.col("sourcePlatform")).alias("platform")).agg(F.count("*").alias("n"))


@query(r"WITH u AS (SELECT seq, sourceUrl AS u FROM stack UNION ALL SELECT -seq, replace(sourceUrl, '://', ': //') FROM stack WHERE seq % 2 = 0 UNION ALL SELECT seq + 1000000000000, 'nothing' FROM stack) SELECT seq, CASE WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#: ]+') THEN regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^(.*?)www\.', '\1') ELSE u END AS domain FROM u")
def extract_domain(spark, d):
    """Host of every post's URL, the input itself where it is none: the posts' own URLs, broken copies and plain words."""
    own = stack(spark, d).select("seq", "sourceUrl")
    broken = own.where("seq % 2 = 0").select((-F.col("seq")).alias("seq"), F.replace(F.col("sourceUrl"), F.lit("://"), F.lit(": //")).alias("sourceUrl"))
    words = own.select((F.col("seq") + 1000000000000).alias("seq"), F.lit("nothing").alias("sourceUrl"))
    return own.unionByName(broken).unionByName(words).select("seq", T.extract_domain(F.col("sourceUrl")).alias("domain"))


@query(f"SELECT seq, CASE WHEN s < 60 THEN CAST(s AS VARCHAR) || 's' WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || 'm' WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || 'h' ELSE CAST(s // 86400 AS VARCHAR) || 'd' END AS age FROM (SELECT seq, CAST(floor(({NOW_MS} - timestamp) / 1000) AS BIGINT) AS s FROM stack)")
def relative_time(spark, d):
    """Age of every post."""
    return stack(spark, d).select("seq", T.relative_time(F.col("timestamp"), NOW_MS).alias("age"))


@query("SELECT seq, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM stack WHERE text IS NOT NULL")
def escaped_html(spark, d):
    """Texts escaped for HTML."""
    return stack(spark, d).where("text is not null").select("seq", T.escape_html(F.col("text")).alias("html"))


@query(
    r"""WITH c AS (SELECT seq, trim(regexp_replace(text, '[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g')) AS t FROM stack WHERE text <> ''),
    f AS (SELECT seq, t, regexp_extract(t, '^(.*?[.!?])(?:\s|$)', 1) AS h FROM c)
    SELECT seq, CASE WHEN h <> '' THEN h WHEN length(t) > 70 THEN substr(t, 1, 65) || '…' ELSE t END AS title, CASE WHEN h <> '' THEN trim(substr(t, length(h) + 1)) WHEN length(t) > 70 THEN t ELSE '' END AS body FROM f"""
)
def card_texts(spark, d):
    """C17 over all posts."""
    return stack(spark, d).where("text <> ''").select("seq", T.card_title(F.col("text")).alias("title"), T.card_body(F.col("text")).alias("body"))


_IGNORED = "['with', 'this', 'that', 'from', 'they', 'your', 'about', 'their', 'there', 'when', 'more']"


@query(
    f"""WITH w AS (SELECT seq, CASE WHEN assignedTag IS NULL OR assignedTag IN ('Unclassified', 'Ads', '') THEN CAST([] AS VARCHAR[]) ELSE [assignedTag] END AS own, regexp_extract_all(text, '#([A-Za-z0-9_]+)', 1)[1:2] AS tags, string_split_regex(regexp_replace(text, '[^A-Za-z0-9_\\s]', '', 'g'), '\\s+') AS ws FROM stack WHERE text <> ''),
    l AS (SELECT seq, list_concat(own, tags, list_filter(ws[2:], lambda x: length(x) >= 4 AND regexp_matches(x, '^[A-Z]') AND NOT regexp_matches(x, '^[A-Z]+$') AND NOT list_contains({_IGNORED}, lower(x)))) AS l FROM w)
    SELECT seq, unnest(list_filter(l, lambda x, i: list_position(l, x) = i)[1:3]) AS entity FROM l"""
)
def local_entities(spark, d):
    """C16 over all posts."""
    return stack(spark, d).where("text is not null").select("seq", F.explode(T.local_entities(F.col("text"), F.col("assignedTag"))).alias("entity"))


_STOPS = "[" + ", ".join(quoted(w) for w in sorted(STOP_WORDS)) + "]"


def _topics(rows: str, column: str) -> str:
    """CTEs that end in `topics` (seq, topic): the topic tag of every text of `rows`."""
    return f"""parts AS (SELECT seq, unnest(ps) AS p, generate_subscripts(ps, 1) AS s FROM (SELECT seq, string_split_regex({column}, '[.!?]+') AS ps FROM {rows} WHERE {column} IS NOT NULL)),
    listed AS (SELECT seq, s, list_filter(string_split_regex(regexp_replace(p, '[^A-Za-z0-9_\\s-]', '', 'g'), '\\s+'), lambda x: length(x) >= 3) AS ws FROM parts), each_word AS (SELECT seq, s, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM listed),
    weighed AS (SELECT seq, lower(w) AS l, arg_min(w, s * 1000000 + i) AS w, min(s * 1000000 + i) AS seen, sum(1 + CASE WHEN NOT regexp_matches(w, '^[A-Z]') THEN 0 WHEN i = 1 THEN 1 ELSE 3 END) AS score FROM each_word WHERE NOT list_contains({_STOPS}, lower(w)) GROUP BY 1, 2),
    topics AS (SELECT seq, trim(substr(upper(substr(w, 1, 1)) || lower(substr(w, 2)), 1, 20)) AS topic FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, seen) AS r FROM weighed) WHERE r = 1)"""


@query(f"WITH {_topics('stack', 'text')} SELECT topic, count(*) AS n FROM topics WHERE topic <> '' GROUP BY 1")
def noun_topics(spark, d):
    """Posts by topic tag."""
    topic = T.clean_tag_name(T.noun_topic(F.col("text")))
    return stack(spark, d).select(topic.alias("topic")).where("topic is not null").groupBy("topic").agg(F.count("*").alias("n"))


@query(
    f"""WITH w AS (SELECT seq, list_filter(string_split_regex(lower(regexp_replace(text, '[^A-Za-z0-9_\\s-]', ' ', 'g')), '\\s+'), lambda x: x <> '') AS ws FROM stack WHERE text IS NOT NULL), h AS (SELECT ws, list_transform(ws, lambda x: length(x) >= 2 AND NOT list_contains({_STOPS}, x)) AS hs FROM w),
    p AS (SELECT list_concat(list_transform(list_filter(range(1, len(ws)), lambda i: hs[i] AND hs[i + 1]), lambda i: array_to_string(ws[i:i + 1], ' ')), list_transform(list_filter(range(1, len(ws) - 1), lambda i: hs[i] AND hs[i + 1] AND hs[i + 2]), lambda i: array_to_string(ws[i:i + 2], ' '))) AS ps FROM h)
    SELECT phrase, count(*) AS n FROM (SELECT unnest(list_distinct(ps)) AS phrase FROM p) GROUP BY 1"""
)
def phrase_counts(spark, d):
    """Neighbouring pairs and triples of weighty words by posts."""
    return stack(spark, d).select(F.explode(T.ngrams(F.col("text"))).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n"))


# --- classification -----------------------------------------------------------------------------------------------
# The tags' keywords written out, so that the twins don't lean on the code that makes them.
WRITTEN = """Lab & Field: lab, field, lab & field, labs, labing, labed, fields, fielding, fielded
Courts: courts, court, courtsing, courtsed
Matches: matches, matche, matchesing, matchesed
Code: code, codes, codeing, codeed
Wellbeing: wellbeing, wellbeings, wellbe, wellbeer, wellbeinged
Money: money, moneys, moneying, moneyed
Kitchen: kitchen, kitchens, kitchening, kitchened
On The Road: the, road, on the road, ons, oning, oned, thes, theing, theed, roads, roading, roaded
Stage & Sound: stage, sound, stage & sound, stages, stageing, stageed, sounds, sounding, sounded
Sky Watch: sky, watch, sky watch, skys, skying, skyed, watchs, watching, watched
Opinion Corner: opinion, corner, opinion corner, opinions, opinioning, opinioned, corners, corn, corning, cornering, cornered
Announcements: announcements, announcement, announcementsing, announcementsed
Local Notices: local, notices, local notices, locals, localing, localed, notice, noticesing, noticesed
Showcase: showcase, showcases, showcaseing, showcaseed"""


def _values(text: str) -> str:
    rows = [line.split(": ") for line in text.splitlines()]
    return ", ".join(f"({k}, {quoted(label)}, {quoted(w)}, {1 + (' ' in w)})" for k, (label, words) in enumerate(rows) for w in words.split(", "))


_KEYWORDS = _values(WRITTEN)
_SCORED = f"WITH {_CLEAN}, kw(pos, name, k, w) AS (VALUES {_KEYWORDS}), sc AS (SELECT seq, name, pos, sum(w) AS score FROM masked JOIN kw ON contains(lower(clean), k) GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, pos) AS r, max(score) OVER (PARTITION BY seq) AS top FROM sc)"


def clean(spark, d):
    """Posts with their text masked, as classification sees it."""
    return stack(spark, d).withColumn("text", T.sanitize(F.col("text")))


@query(f"{_SCORED} SELECT seq, name, CAST(score AS BIGINT) AS score FROM sc")
def keyword_scores(spark, d):
    """Every tag with a hit, on masked texts."""
    rows = clean(spark, d).select("seq", F.explode(C.tag_scores(F.col("text"), TAGS)).alias("x"))
    return rows.select("seq", "x.name", F.col("x.score").cast("long").alias("score"))


@query(f"{_SCORED} SELECT seq, CAST(r AS BIGINT) AS place, name, round(score / top, 2) AS score FROM rk WHERE r <= 3")
def top3_tags(spark, d):
    """The three best tags of every post."""
    rows = clean(spark, d).select("seq", F.posexplode(C.top_tags(C.tag_scores(F.col("text"), TAGS))).alias("k", "x"))
    return rows.select("seq", (F.col("k") + 1).cast("long").alias("place"), "x.name", F.col("x.share").alias("score"))


# Tags that topics became, as the tool would have added them.
DYNAMIC = [Tag("Harbour", None, 0, ("harbour", "ferry", "quay")), Tag("Kitchen", None, 1, ("recipe", "oven")), Tag("Storms", None, 2, ("storm", "forecast", "wind"))]
_MORE = _values("Harbour: harbour, ferry, quay\nKitchen: recipe, oven\nStorms: storm, forecast, wind")


_MERGED = f"""{_SCORED}, kw2(pos, name, k, w) AS (VALUES {_MORE}), sc2 AS (SELECT seq, name, pos, sum(w) AS score FROM masked JOIN kw2 ON contains(lower(clean), k) GROUP BY ALL),
    rk2 AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, pos) AS r, max(score) OVER (PARTITION BY seq) AS top FROM sc2),
    u AS (SELECT seq, name, round(score / top, 2) AS score, 0 AS l, r FROM rk WHERE r <= 3 UNION ALL SELECT seq, name, round(score / top, 2), 1, r FROM rk2 WHERE r <= 3),
    o AS (SELECT *, row_number() OVER (PARTITION BY seq, name ORDER BY score DESC, l, r) AS again FROM u),
    p AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, l, r) AS place FROM o WHERE again = 1)"""


@query(_MERGED + " SELECT seq, CAST(place AS BIGINT) AS place, name, score FROM p WHERE place <= 3")
def merged_tags(spark, d):
    """The ranked lists of tags and dynamic tags as one."""
    rows = clean(spark, d).select("seq", F.posexplode(C.merged_tags(F.col("text"), TAGS, DYNAMIC)).alias("k", "x"))
    return rows.select("seq", (F.col("k") + 1).cast("long").alias("place"), "x.name", F.col("x.share").alias("score"))


@query(f"{_SCORED} SELECT coalesce(name, 'Unclassified') AS tag, count(*) AS n FROM stack LEFT JOIN (SELECT * FROM rk WHERE r = 1) USING (seq) WHERE length(text) BETWEEN 20 AND 2000 GROUP BY 1")
def primary_tag_counts(spark, d):
    """Flagship: filter by length, mask, score, best tag, count."""
    rows = stack(spark, d).where(F.length("text").between(20, 2000)).select(T.sanitize(F.col("text")).alias("text"))
    return rows.groupBy(F.coalesce(F.get(C.tag_scores(F.col("text"), TAGS), F.lit(0))["name"], F.lit("Unclassified")).alias("tag")).agg(F.count("*").alias("n"))


_P, _W = significant_phrases(PROMPT), significant_keywords(PROMPT)


@query("SELECT seq FROM stack WHERE " + " OR ".join(f"contains(lower(text), {quoted(p)})" for p in _P) + " OR (" + " + ".join(f"CAST(contains(lower(text), {quoted(w)}) AS INT)" for w in _W) + ") >= 2")
def match_gate(spark, d):
    """Posts that the match prompt lets through."""
    return stack(spark, d).where(C.matches(F.col("text"), PROMPT)).select("seq")


_LABELLED = "(VALUES " + ", ".join(f"({quoted(t.label)})" for t in [*TAGS, *DYNAMIC]) + ")"


@query(
    _MERGED + f""", {_topics('masked', 'clean')}, b AS (SELECT seq, name FROM p WHERE place = 1), lb AS (SELECT DISTINCT ON (lower(l)) l FROM {_LABELLED} x(l))
    SELECT CASE WHEN b.name IS NOT NULL THEN 'keywords' WHEN topic <> '' THEN 'topic' ELSE 'none' END AS tier, coalesce(b.name, l, nullif(topic, ''), 'Unclassified') AS category, count(*) AS n
    FROM stack LEFT JOIN b ON b.seq = stack.seq LEFT JOIN topics t ON t.seq = stack.seq LEFT JOIN lb ON lower(l) = lower(topic) GROUP BY 1, 2"""
)
def classified_posts(spark, d):
    """The cascade of keywords, topic and none, by tier."""
    return C.classify(clean(spark, d).select("seq", "text"), TAGS, dynamic=DYNAMIC).groupBy("tier", "category").agg(F.count("*").alias("n"))


@query(
    f"""{_SCORED}, {_topics('masked', 'clean')}, f AS (SELECT lower(topic) AS k, min(seq) AS seq, arg_min(topic, seq) AS label FROM topics WHERE topic <> '' AND seq NOT IN (SELECT seq FROM rk) AND lower(topic) NOT IN (SELECT lower(l) FROM {_LABELLED} x(l)) GROUP BY 1)
    SELECT label, seq FROM f ORDER BY seq LIMIT 10"""
)
def dynamic_tags(spark, d):
    """Topics of unclassified posts that become tags."""
    rows = C.classify(clean(spark, d).select("seq", "text"), TAGS).where("tier = 'topic'")
    return S.dynamic_tags(rows, "category")


@query(f"SELECT label, isEnabled, coalesce(prompt, 'Find posts related to ' || label || '.') AS prompt FROM tracked_tags")
def suggested_prompts(spark, d):
    """Prompts of tags without one."""
    t = read_table(spark, d, "tracked_tags")
    return t.select("label", "isEnabled", F.coalesce("prompt", F.concat(F.lit("Find posts related to "), F.col("label"), F.lit("."))).alias("prompt"))


# --- filters ------------------------------------------------------------------------------------------------------
_UNDER = "({h} = lower({d}) OR ends_with({h}, '.' || lower({d})))"
_STORED = f"""NOT EXISTS (SELECT 1 FROM ignore_rules r WHERE r.kind = 'link' AND r.value = s.sourceUrl) AND NOT EXISTS (SELECT 1 FROM ignore_rules r WHERE r.kind = 'tag' AND lower(r.value) = lower(s.assignedTag))
    AND NOT EXISTS (SELECT 1 FROM ignore_rules r WHERE r.kind = 'domain' AND {_UNDER.format(h="(" + HOST.replace("sourcePlatform", "s.sourcePlatform") + ")", d="r.value")})"""


@query(f"SELECT seq FROM stack s WHERE {_STORED}")
def active_items(spark, d):
    """What the ignore rules leave of stored posts."""
    return O.without_ignored(stack(spark, d), read_table(spark, d, "ignore_rules"), keywords=False).select("seq")


@query(f"SELECT seq FROM stack s WHERE {_STORED} AND NOT EXISTS (SELECT 1 FROM ignore_rules r WHERE r.kind = 'keyword' AND contains(lower(s.text), lower(r.value)))")
def incoming_items(spark, d):
    """What the ignore rules leave of incoming posts."""
    return O.without_ignored(stack(spark, d), read_table(spark, d, "ignore_rules")).select("seq")


_SITE = f"""hosts AS (SELECT DISTINCT {HOST} AS h FROM stack), near AS (SELECT h, arg_min(domain, pos) AS site FROM hosts JOIN sites ON isEnabled AND domain <> '*' AND {_UNDER.format(h='h', d='domain')} GROUP BY h),
    s AS (SELECT t.*, coalesce(site, 'Other') AS site FROM stack t LEFT JOIN near ON near.h = {HOST})"""


@query(f"WITH on_ AS (SELECT DISTINCT {HOST} AS h FROM stack), f AS (SELECT h, arg_min(isEnabled, pos) AS ok FROM on_ JOIN sites ON domain <> '*' AND {_UNDER.format(h='h', d='domain')} GROUP BY h) SELECT seq FROM stack JOIN f ON f.h = {HOST} WHERE ok OR (SELECT bool_or(isEnabled) FROM sites WHERE domain = '*')")
def enabled_sites(spark, d):
    """posts of enabled sites."""
    return O.site_enabled(stack(spark, d), read_table(spark, d, "sites")).select("seq")


@query(f"WITH {_SITE} SELECT seq, site FROM s")
def site_assignment(spark, d):
    """The site of every post."""
    return O.with_site(stack(spark, d), read_table(spark, d, "sites")).select("seq", "site")


@query("SELECT seq FROM stack WHERE contains(lower(assignedTag), 'court') OR contains(lower(text), 'court') OR contains(lower(authorName), 'court') OR contains(lower(sourcePlatform), 'court')")
def global_search(spark, d):
    """search over all columns."""
    return O.search(stack(spark, d), " Court ").select("seq")


@query("SELECT seq FROM stack WHERE contains(lower(assignedTag), 'storm') OR contains(lower(text), 'storm')")
def dashboard_search(spark, d):
    """search over text and tag."""
    return O.search(stack(spark, d), "storm", ("text", "assignedTag")).select("seq")


@query(f"SELECT 'Favorites' AS view, seq FROM stack WHERE isFavorite UNION ALL SELECT 'Ads', seq FROM stack WHERE isAd UNION ALL SELECT 'Kitchen', seq FROM stack WHERE {TAG} = 'Kitchen' UNION ALL SELECT 'Unclassified', seq FROM stack WHERE {TAG} = 'Unclassified'")
def tag_views(spark, d):
    """Views of tags and facets."""
    out = None
    for tag in ("Favorites", "Ads", "Kitchen", "Unclassified"):
        one = O.by_tag(stack(spark, d), tag).select(F.lit(tag).alias("view"), "seq")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT seq FROM stack WHERE coalesce(isFavorite, false) OR {TAG} <> 'Courts'")
def retained_favorites(spark, d):
    """what stays when a tag is cleared."""
    return O.cleared(stack(spark, d), "Courts").select("seq")


# --- aggregates and rankings --------------------------------------------------------------------------------------
@query(f"SELECT 'All' AS facet, count(*) AS n FROM stack UNION ALL SELECT 'Favorites', count(*) FROM stack WHERE isFavorite HAVING count(*) > 0 UNION ALL SELECT facet, sum(n)::BIGINT FROM (SELECT {TAG} AS facet, count(*) AS n FROM stack GROUP BY 1 UNION ALL SELECT 'Ads', count(*) FROM stack WHERE isAd HAVING count(*) > 0) GROUP BY facet")
def category_facets(spark, d):
    """A1 to A3: counts of all facets."""
    return O.category_facets(stack(spark, d))


@query(f"WITH {_SITE} SELECT site, count(*) AS n, arg_max(timestamp, seq) AS latest FROM s GROUP BY site")
def site_counts(spark, d):
    """Posts and latest post by site."""
    return O.with_site(stack(spark, d), read_table(spark, d, "sites")).groupBy("site").agg(F.count("*").alias("n"), O.latest().alias("latest"))


@query("SELECT label, pos, coalesce(latest, 0) AS latest, row_number() OVER (ORDER BY coalesce(latest, 0) DESC, pos, label) AS place FROM tracked_tags LEFT JOIN (SELECT assignedTag, arg_max(timestamp, seq) AS latest FROM stack GROUP BY 1) ON label = assignedTag")
def tag_recency(spark, d):
    """Tags in the order of their latest posts."""
    return O.tag_order(stack(spark, d), read_table(spark, d, "tracked_tags"))


@query("SELECT trim(authorName) AS author, count(*) AS n, min(seq) AS first_seq FROM stack WHERE trim(authorName) <> '' GROUP BY 1 ORDER BY n DESC, first_seq LIMIT 10")
def top10_authors(spark, d):
    """A5, T5: the authors of most posts."""
    return O.top_authors(stack(spark, d))


@query("WITH c AS (SELECT trim(authorName) AS author, count(*) AS n, min(seq) AS first_seq FROM stack WHERE trim(authorName) <> '' GROUP BY 1), a AS (SELECT arg_min(author, struct_pack(n := n, s := -first_seq)) AS author FROM c) SELECT * FROM (SELECT * FROM c ORDER BY n DESC, first_seq LIMIT 10) UNION SELECT c.* FROM c JOIN a USING (author)")
def top_authors_with_active(spark, d):
    """T5: the authors of most posts and the active one, here the author of fewest posts that came last."""
    s = stack(spark, d)
    c = s.select(F.trim("authorName").alias("a"), "seq").where("a <> ''").groupBy("a").agg(F.count("*").alias("n"), F.min("seq").alias("s"))
    last = c.agg(F.min_by("a", F.struct("n", -F.col("s"))).alias("a")).first()["a"]
    return O.top_authors(s, active=last)


@query(f"WITH t AS (SELECT label, pos, coalesce(latest, 0) AS latest FROM tracked_tags LEFT JOIN (SELECT assignedTag, arg_max(timestamp, seq) AS latest FROM stack GROUP BY 1) ON label = assignedTag WHERE isEnabled AND label NOT IN ('Ads', 'Unclassified')), p AS (SELECT 'All' AS label, 0 AS part, 0 AS place UNION ALL SELECT 'Favorites', 0, 1 UNION ALL SELECT 'Ads', 2, 0 UNION ALL SELECT 'Unclassified', 2, 1 UNION ALL SELECT label, 1, row_number() OVER (ORDER BY latest DESC, pos, label) FROM t), n AS (SELECT facet, sum(n)::BIGINT AS n FROM (SELECT 'All' AS facet, count(*) AS n FROM stack UNION ALL SELECT 'Favorites', count(*) FROM stack WHERE isFavorite UNION ALL SELECT 'Ads', count(*) FROM stack WHERE isAd UNION ALL SELECT {TAG}, count(*) FROM stack GROUP BY 1) GROUP BY 1) SELECT label, coalesce(n, 0) AS n, row_number() OVER (ORDER BY part, place) - 1 AS place FROM p LEFT JOIN n ON facet = label")
def tag_tabs(spark, d):
    """Pinned tabs and tags by recency, with their counts."""
    return O.tag_tabs(stack(spark, d), read_table(spark, d, "tracked_tags"))


@query(f"WITH {_SITE}, b AS (SELECT site, count(*) AS n, arg_max(timestamp, seq) AS latest FROM s GROUP BY site), u AS (SELECT 'All' AS site, 0 AS part, (SELECT count(*) FROM stack) AS n, 0 AS latest, 0 AS pos UNION ALL SELECT domain, 1, coalesce(n, 0), coalesce(latest, 0), pos FROM sites LEFT JOIN b ON site = domain WHERE isEnabled AND domain <> '*' UNION ALL SELECT site, 2, n, 0, 0 FROM b WHERE site = 'Other') SELECT site, n, row_number() OVER (ORDER BY part, latest DESC, pos, site) - 1 AS place FROM u")
def site_tabs(spark, d):
    """A4, T4: All, sites by recency, and Other."""
    return O.site_tabs(stack(spark, d), read_table(spark, d, "sites"))


@query(f"WITH h AS (SELECT DISTINCT sourcePlatform AS host, {HOST} AS h FROM stack WHERE sourcePlatform IS NOT NULL), f AS (SELECT h, arg_min(CASE WHEN isEnabled THEN domain ELSE '' END, pos) AS site FROM (SELECT DISTINCT h FROM h) JOIN sites ON domain <> '*' AND {_UNDER.format(h='h', d='domain')} GROUP BY h) SELECT host, coalesce(nullif(site, ''), 'All') AS site FROM h LEFT JOIN f USING (h)")
def tab_sites(spark, d):
    """Tab host to site, for every host seen."""
    return O.tab_site(stack(spark, d).select(F.col("sourcePlatform").alias("host")).where("host is not null").distinct(), read_table(spark, d, "sites"))


@query("SELECT seq FROM stack WHERE authorName = (SELECT arg_max(authorName, struct_pack(n := n, a := authorName)) FROM (SELECT authorName, count(*) AS n FROM stack WHERE trim(authorName) <> '' GROUP BY 1))")
def author_items(spark, d):
    """posts of one author, here the one of most posts."""
    s = stack(spark, d)
    name = s.where(F.trim("authorName") != "").groupBy("authorName").agg(F.count("*").alias("n")).agg(F.max_by("authorName", F.struct("n", "authorName")).alias("a")).first()["a"]
    return O.by_author(s, name).select("seq")


@query("WITH t AS (SELECT lower(label) AS l, arg_min(label, pos) AS label, arg_min(isEnabled, pos) AS e FROM tracked_tags GROUP BY 1) SELECT coalesce(label, 'none') AS label, coalesce(e, false) AS isTracked, count(*) AS n FROM stack LEFT JOIN t ON lower(assignedTag) = l GROUP BY ALL")
def tracked_posts(spark, d):
    """Posts with their configured tag, counted."""
    return O.tracked(stack(spark, d), read_table(spark, d, "tracked_tags")).groupBy(F.coalesce("label", F.lit("none")).alias("label"), "isTracked").agg(F.count("*").alias("n"))


@query("SELECT kind, value FROM ignore_rules WHERE NOT (kind IN ('tag', 'domain') AND lower(substr(value, 1, 1)) < 'n') AND NOT (kind = 'keyword' AND value = lower(value))")
def rules_removed(spark, d):
    """Ignore rules after some were removed, tags and domains under another case, keywords in lower case."""
    r = read_table(spark, d, "ignore_rules").select("kind", "value")
    gone = r.where("kind in ('tag', 'domain') and lower(substr(value, 1, 1)) < 'n'").select("kind", F.upper("value").alias("value")).unionByName(r.where("kind = 'keyword'").select("kind", F.lower("value").alias("value")))
    return O.without_values(r, gone)


@query("SELECT trim(authorName) AS author, max(seq) AS seq, arg_max(timestamp, seq) AS timestamp FROM stack WHERE trim(authorName) <> '' GROUP BY 1")
def first_by_author(spark, d):
    """The newest post of every author."""
    return O.first_by_author(stack(spark, d))


@query(f"SELECT count(*) AS total, count(*) FILTER ({TAG} <> 'Unclassified') AS classified, count(*) FILTER (isFavorite) AS favorites, max(timestamp) AS last_ms, CAST(coalesce(floor(100.0 * count(*) FILTER ({TAG} <> 'Unclassified') / nullif(count(*), 0) + 0.5), 0) AS BIGINT) AS rate FROM stack")
def telemetry(spark, d):
    """Totals and the classification rate."""
    s = stack(spark, d).withColumn("t", F.coalesce("assignedTag", F.lit("Unclassified")))
    c = F.count_if(F.col("t") != "Unclassified")
    return s.agg(F.count("*").alias("total"), c.alias("classified"), F.count_if(F.col("isFavorite")).alias("favorites"), F.max("timestamp").alias("last_ms"), F.coalesce(F.floor(100 * c / F.nullif(F.count("*"), F.lit(0)) + 0.5), F.lit(0)).cast("long").alias("rate"))


@query("WITH c AS (SELECT sourcePlatform AS platform, count(*) AS n FROM stack WHERE sourcePlatform IS NOT NULL GROUP BY 1) SELECT platform, n, CAST(floor(100.0 * n / greatest(max(n) OVER (), 1) + 0.5) AS BIGINT) AS pct FROM c")
def platform_distribution(spark, d):
    """Raw platforms as shares of the greatest."""
    c = stack(spark, d).where("sourcePlatform is not null").groupBy(F.col("sourcePlatform").alias("platform")).agg(F.count("*").alias("n"))
    return O.percentages(c, "platform")


@query(f"SELECT DISTINCT {TAG} AS tag FROM stack WHERE {TAG} NOT IN ('Ads', 'Unclassified')")
def distinct_categories(spark, d):
    """Tags in use."""
    return stack(spark, d).select(F.coalesce("assignedTag", F.lit("Unclassified")).alias("tag")).where("tag not in ('Ads', 'Unclassified')").distinct()


@query(f"SELECT seq FROM stack WHERE {TAG} = 'Unclassified' ORDER BY seq DESC LIMIT 5")
def head5_unclassified(spark, d):
    """The batch of the idle retry."""
    return O.by_tag(stack(spark, d), "Unclassified").orderBy(F.desc("seq")).limit(5).select("seq")


# --- ordered views ------------------------------------------------------------------------------------------------
@query(f"WITH x AS (SELECT seq, CAST(to_timestamp(timestamp / 1000) AT TIME ZONE 'UTC' AS DATE) AS d, CAST(to_timestamp({NOW_MS} / 1000) AT TIME ZONE 'UTC' AS DATE) AS today FROM stack), y AS (SELECT *, lag(d) OVER (ORDER BY seq DESC) AS p FROM x) SELECT seq, CASE WHEN d = today THEN 'Today' WHEN d = today - 1 THEN 'Yesterday' ELSE strftime(d, '%Y-%m-%d') END AS label FROM y WHERE p IS NULL OR p <> d")
def day_separators(spark, d):
    """Day labels between posts."""
    return O.day_separators(stack(spark, d), NOW_MS)


@query("SELECT seq, row_number() OVER (ORDER BY seq DESC) - 1 AS position FROM stack WHERE isFavorite")
def positions(spark, d):
    """Place of every post in a view."""
    return O.positions(O.by_tag(stack(spark, d), "Favorites"))


@query("WITH t AS (SELECT label, pos FROM tracked_tags WHERE isEnabled AND label <> 'Ads' UNION ALL SELECT 'Unclassified', 1073741824) SELECT label, coalesce(lead(label) OVER (ORDER BY pos, label), first_value(label) OVER (ORDER BY pos, label)) AS next, coalesce(lag(label) OVER (ORDER BY pos, label), last_value(label) OVER (ORDER BY pos, label ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS previous FROM t")
def tag_rotation(spark, d):
    """Next and previous tags."""
    return O.next_tags(read_table(spark, d, "tracked_tags"))


# --- state --------------------------------------------------------------------------------------------------------
@query("SELECT seq FROM (SELECT seq, text, row_number() OVER (PARTITION BY text ORDER BY seq) AS r FROM stack) WHERE text IS NULL OR r = 1")
def deduplicated(spark, d):
    """One row per text."""
    return O.dedup(stack(spark, d)).select("seq")


@query(
    """WITH k AS (SELECT *, sourceUrl IS NOT NULL AND regexp_matches(sourceUrl, '^https?://') AS keyed FROM stack), t AS (SELECT sourceUrl, coalesce(text, '') AS text, min(seq) AS seq FROM k WHERE keyed GROUP BY ALL),
    f AS (SELECT sourceUrl, list_reduce(list([text, CAST(seq AS VARCHAR)] ORDER BY seq), lambda a, x: CASE WHEN contains(a[1], x[1]) THEN a ELSE [a[1] || chr(10) || chr(10) || x[1], x[2]] END) AS m, count(*) AS n_texts FROM t GROUP BY 1),
    o AS (SELECT sourceUrl, arg_min(timestamp, seq) AS timestamp, bool_or(coalesce(isAd, false)) AS isAd, coalesce(arg_min(coalesce(isFavorite, false), seq), false) AS isFavorite FROM k WHERE keyed GROUP BY 1)
    SELECT sourceUrl, CAST(m[2] AS BIGINT) AS seq, m[1] AS text, timestamp, isAd, isFavorite, n_texts FROM f JOIN o USING (sourceUrl)
    UNION ALL SELECT sourceUrl, seq, text, timestamp, coalesce(isAd, false), coalesce(isFavorite, false), 1 FROM k WHERE NOT keyed"""
)
def upserted(spark, d):
    """Posts of one URL merged."""
    return S.upsert_by_url(stack(spark, d))


@query()
def upserted_classified(spark, d):
    """The merged posts classified anew, by tag."""
    merged = S.upsert_by_url(clean(spark, d).withColumn("isFavorite", F.col("isFavorite")))
    return C.classify(merged.select("seq", "text"), TAGS).groupBy(F.col("category").alias("tag")).agg(F.count("*").alias("n"))


@query(f"{_SCORED} SELECT seq, name AS tag, coalesce(isFavorite, false) AS isFavorite FROM stack JOIN (SELECT * FROM rk WHERE r = 1) USING (seq) WHERE contains(lower(text), 'road') OR contains(lower(text), 'kitchen')")
def recomputed(spark, d):
    """After a change of tags and prompt, posts that pass the new gate under their new tags; here those with keywords."""
    rows = C.reclassified(clean(spark, d), TAGS, '"road" "kitchen"').where("tier = 'keywords'")
    return rows.select("seq", F.col("assignedTag").alias("tag"), F.coalesce("isFavorite", F.lit(False)).alias("isFavorite"))


@query(
    """WITH a AS (SELECT DISTINCT ON (actionId) * FROM mutations ORDER BY actionId), m AS (SELECT seq, count(*) FILTER (kind = 'FAVORITE_TOGGLED') % 2 = 1 AS flip, bool_or(kind = 'ITEM_DELETED') AS gone FROM a GROUP BY seq),
    t AS (SELECT seq, newTag FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY actedAt DESC, actionId DESC) AS r FROM a WHERE kind = 'ITEM_RETAGGED' AND newTag IS NOT NULL) WHERE r = 1)
    SELECT s.seq, coalesce(newTag, assignedTag) AS tag, coalesce(isFavorite, false) <> coalesce(flip, false) AS favorite FROM stack s LEFT JOIN m ON s.seq = m.seq LEFT JOIN t ON s.seq = t.seq WHERE NOT coalesce(gone, false)"""
)
def after_mutations(spark, d):
    """Posts after all user actions."""
    return O.after_mutations(stack(spark, d), read_table(spark, d, "mutations")).select("seq", F.col("assignedTag").alias("tag"), F.col("isFavorite").alias("favorite"))


_BARE = r"regexp_replace({n}, '[@_\s0-9-]', '', 'g')"
_HANDLE = r"lower(regexp_replace(regexp_extract(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), '([^/]+)/*$', 1), '^([^@]*)@', '\1'))"


@query(
    # the twin's edit distance counts bytes, so letters beyond ASCII become capitals, which no name in lower case has
    f"""WITH a AS (SELECT authorRef AS r, lower(trim(authorName)) AS n, translate({_BARE.format(n='lower(trim(authorName))')}, '\u00a0\u00ad\u00e9\u00eb\u00f8\u0308\u03b2\u03bf\u0430\u043e\u0455\u0456\u2009\u200d\u2013\u3000\ufeff', 'ABCDEFGHIJKLMNOPQ') AS m, {_HANDLE.format(u="coalesce(authorUrl, '')")} AS h FROM authors WHERE trim(authorName) <> '')
    SELECT x.r AS a, y.r AS b FROM a x JOIN a y ON x.r < y.r AND (x.n = y.n OR x.m = y.m AND length(x.m) > 2 OR length(x.m) > 3 AND length(y.m) > 3 AND (contains(x.m, y.m) OR contains(y.m, x.m)) OR x.h <> '' AND x.h = y.h
    OR greatest(length(x.m), length(y.m)) > 4 AND 1 - levenshtein(x.m, y.m) / greatest(length(x.m), length(y.m)) > 0.8)"""
)
def author_pairs(spark, d):
    """Authors that match."""
    return A.author_pairs(read_table(spark, d, "authors"))


@query(
    f"""WITH p AS ({SQL['author_pairs']}), m AS (SELECT map_from_entries(list((b, l))) AS m FROM (SELECT b, list(a) AS l FROM p GROUP BY b)), o AS (SELECT list([authorRef] ORDER BY authorRef) AS l FROM authors WHERE trim(authorName) <> ''),
    k AS (SELECT unnest(list_reduce(l, lambda acc, x: CASE WHEN list_has_any(acc, coalesce(m[x[1]], CAST([] AS BIGINT[]))) THEN acc ELSE list_concat(acc, x) END)) AS ref FROM o, m),
    t AS (SELECT b, min(a) AS of FROM p JOIN k ON p.a = k.ref WHERE b NOT IN (SELECT ref FROM k) GROUP BY b)
    SELECT a.authorRef, trim(coalesce(c.authorName, a.authorName)) AS canonical FROM authors a LEFT JOIN t ON t.b = a.authorRef LEFT JOIN authors c ON c.authorRef = t.of"""
)
def canonical_authors(spark, d):
    """Canonical names, as a fold over all authors in order gives them."""
    return A.canonical_names(read_table(spark, d, "authors"))


@query("SELECT label, 'kept' AS state FROM tracked_tags UNION ALL SELECT v, 'added' FROM (VALUES ('kitchen'), ('Gardening')) x(v) WHERE lower(v) NOT IN (SELECT lower(label) FROM tracked_tags)")
def tags_added(spark, d):
    """Tags added without regard to case."""
    t = read_table(spark, d, "tracked_tags")
    new = spark.createDataFrame([("kitchen",), ("Gardening",)], "label string")
    fresh = new.join(t.select(F.lower("label").alias("low")), F.lower("label") == F.col("low"), "left_anti")
    return t.select("label", F.lit("kept").alias("state")).unionByName(fresh.select("label", F.lit("added").alias("state")))


_CHANGES = [("kitchen", "toggle", 1), ("Gardening", "add", 2), ("gardening", "toggle", 3), ("COURTS", "remove", 4), ("Courts", "toggle", 5), ("Code", "remove", 6), ("Code", "add", 7), ("Money", "add", 8), ("Money", "toggle", 9), ("money", "toggle", 10), ("Nowhere", "toggle", 11), ("Nowhere", "remove", 12)]


@query("SELECT label, CASE WHEN lower(label) = 'kitchen' THEN NOT isEnabled WHEN label = 'Code' THEN true ELSE isEnabled END AS isEnabled FROM tracked_tags WHERE lower(label) <> 'courts' UNION ALL SELECT 'Gardening', false")
def tags_after_changes(spark, d):
    """Tags after a list of additions, removals and switches, whatever the case of the labels."""
    changes = spark.createDataFrame(_CHANGES, "label string, op string, at long")
    return after_changes(read_table(spark, d, "tracked_tags").select("label", "isEnabled"), changes, ("label",), folded=True)


# --- sinks and sources --------------------------------------------------------------------------------------------
@query("SELECT coalesce(id, '') AS id, coalesce(strftime(make_timestamp_ms(timestamp), '%Y-%m-%dT%H:%M:%S.%g') || 'Z', '') AS time, coalesce(nullif(sourcePlatform, ''), 'unknown') AS platform, coalesce(authorName, '') AS author, coalesce(authorUrl, '') AS author_url, coalesce(sourceUrl, '') AS url, coalesce(nullif(assignedTag, ''), 'Unclassified') AS tag, CASE WHEN isFavorite THEN 'TRUE' ELSE 'FALSE' END AS favorite, coalesce(text, '') AS text FROM stack")
def csv_projection(spark, d):
    """Rows of the CSV export."""
    return O.csv_rows(stack(spark, d))


@query("SELECT seq, CAST(to_json({'id': id, 'timestamp': timestamp, 'sourcePlatform': sourcePlatform, 'sourceUrl': sourceUrl, 'authorName': authorName, 'authorUrl': authorUrl, 'text': text, 'assignedTag': assignedTag, 'isFavorite': isFavorite, 'isAd': isAd}) AS VARCHAR) AS json FROM stack s WHERE " + _STORED)
def json_projection(spark, d):
    """Rows of the JSON export of the active feed."""
    return stores.json_rows(O.without_ignored(stack(spark, d), read_table(spark, d, "ignore_rules"), keywords=False))


def _escaped(c: str) -> str:
    return f"replace(replace(replace(replace(replace(coalesce({c}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


_CARD = r"""c AS (SELECT *, trim(regexp_replace(text, '[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g')) AS t FROM stack), f AS (SELECT *, regexp_extract(t, '^(.*?[.!?])(?:\s|$)', 1) AS h FROM c),
    k AS (SELECT *, CASE WHEN text IS NULL OR text = '' THEN '' WHEN h <> '' THEN h WHEN length(t) > 70 THEN substr(t, 1, 65) || '…' ELSE t END AS title, CASE WHEN text IS NULL OR text = '' THEN '' WHEN h <> '' THEN trim(substr(t, length(h) + 1)) WHEN length(t) > 70 THEN t ELSE '' END AS body FROM f)"""


@query(
    f"""WITH {_CARD} SELECT seq, '<article class="card" data-tag="' || {_escaped(TAG)} || '"><h3>' || {_escaped('title')} || '</h3><p>' || {_escaped('body')} || '</p><span class="author">' || {_escaped('authorName')} || '</span><a href="' || {_escaped('sourceUrl')} || '">' || {_escaped('sourcePlatform')}
    || '</a><time>' || coalesce(strftime(make_timestamp_ms(timestamp), '%Y-%m-%dT%H:%M:%S.%g') || 'Z', '') || '</time></article>' AS html FROM k"""
)
def html_diary(spark, d):
    """Fragments of the HTML diary."""
    return stores.html_cards(stack(spark, d))


@query(f"WITH {_CARD} SELECT seq FROM k WHERE {TAG} = 'Kitchen' AND contains(lower(concat_ws(' ', {TAG}, title, body, authorName, sourcePlatform)), 'oven')")
def diary_search(spark, d):
    """cards of the diary under a category that hold a word."""
    return stores.search_cards(stack(spark, d), "Kitchen", " Oven ").select("seq")


_PLAIN_ROWS = "text SIMILAR TO '[!-~]+( [!-~]+)*' AND length(text) BETWEEN 20 AND 1800 AND authorName SIMILAR TO '[!-~]+( [!-~]+)*' AND NOT regexp_matches(text, 'Follow|Like|Comment|Share')"


@query(
    f"""SELECT seq AS page_id, ['x.com', 'linkedin.com', 'facebook.com', 'youtube.com'][seq % 4 + 1] AS sourcePlatform, CASE seq % 4 WHEN 0 THEN 'Tweet by: ' || authorName || chr(10) || chr(10) || text WHEN 3 THEN 'Comment by ' || authorName || ':' || chr(10) || text ELSE 'Post by: ' || authorName || chr(10) || chr(10) || text END AS text,
    CASE seq % 4 WHEN 0 THEN 'https://x.com/u' || seq || '/status/' || seq WHEN 1 THEN 'https://linkedin.com/posts/' || seq WHEN 2 THEN 'https://facebook.com/u' || seq || '/posts/' || seq ELSE 'https://youtube.com/watch?v=' || seq END AS sourceUrl, CASE seq % 4 WHEN 3 THEN '' ELSE authorName END AS authorName, seq % 4 = 2 AND coalesce(isAd, false) AS isAd
    FROM stack WHERE {_PLAIN_ROWS}"""
)
def platform_pages(spark, d):
    """Posts of plain characters read back out of pages as four platforms build them."""
    plain = "^[!-~]+( [!-~]+)*$"
    rows = stack(spark, d).where(F.col("text").rlike(plain) & F.length("text").between(20, 1800) & F.col("authorName").rlike(plain) & ~F.col("text").rlike("Follow|Like|Comment|Share"))
    text, name, k = T.escape_html(F.col("text")), T.escape_html(F.col("authorName")), F.col("seq").cast("string")
    c = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    badge = F.when(F.coalesce("isAd", F.lit(False)), F.lit("<span>Sponsored</span>")).otherwise(F.lit(""))
    made = [
        ("x.com/home", c('<article data-testid="tweet"><div data-testid="User-Name"><div><a href="/u', k, '">', name, '</a></div><span>·</span><a href="/u', k, "/status/", k, '">1h</a></div><div data-testid="tweetText">', text, "</div></article>")),
        ("linkedin.com/feed", c('<div class="feed-shared-update-v2"><a class="update-components-actor__meta-link" href="/in/u', k, '"><span class="update-components-actor__title">', name, '</span></a><div class="update-components-text">', text, '</div><a href="/posts/', k, '">open</a></div>')),
        ("facebook.com/", c('<div role="article"><h3><strong>', name, '</strong></h3>', badge, '<div dir="auto">', text, '</div><div role="button">Like</div><a href="/u', k, "/posts/", k, '">1 h</a></div>')),
        ("youtube.com/watch?v=", c('<ytd-comment-thread-renderer><span id="author-text">', name, '</span><div id="content-text">', text, "</div></ytd-comment-thread-renderer>")),
    ]
    n = F.col("seq") % 4
    pick = lambda j: F.when(n == 0, made[0][j] if j else F.lit(made[0][0])).when(n == 1, made[1][j] if j else F.lit(made[1][0])).when(n == 2, made[2][j] if j else F.lit(made[2][0])).otherwise(made[3][j] if j else c(made[3][0], k))
    shown = rows.select(F.col("seq").alias("page_id"), F.concat(F.lit("https://"), pick(0)).alias("url"), c("<html><body><nav>menu</nav>", pick(1), "</body></html>").alias("html"))
    return pages.posts_of_pages(shown).drop("authorUrl")


@query()
def html_roundtrip(spark, d):
    """Posts read back out of pages made of the diary's fragments."""
    cards = stores.html_cards(stack(spark, d).where(F.length("text") >= 60))
    made = cards.select(F.col("seq").alias("page_id"), F.lit("https://chirrup.example/home").alias("url"), F.concat(F.lit("<html><body><nav>menu</nav>"), F.col("html"), F.lit("</body></html>")).alias("html"))
    return pages.posts_of_pages(made)


@query("""WITH up AS (SELECT id, CASE WHEN pos % 4 = 0 THEN NULL ELSE domain || '.new' END AS domain, CASE WHEN pos % 4 = 2 THEN NOT isEnabled END AS isEnabled FROM sites WHERE pos % 2 = 0 UNION ALL SELECT id || '_b', 'added.' || domain, false FROM sites WHERE pos % 3 = 0)
    SELECT coalesce(s.id, up.id) AS id, coalesce(up.domain, s.domain) AS domain, coalesce(up.isEnabled, s.isEnabled) AS isEnabled FROM sites s FULL JOIN up ON s.id = up.id""")
def state_merged(spark, d):
    """The stored sites merged with an update that changes rows, leaves columns null and adds rows."""
    s = read_table(spark, d, "sites").select("id", "domain", "isEnabled", "pos")
    changed = s.where("pos % 2 = 0").select("id", F.when(F.col("pos") % 4 != 0, F.concat("domain", F.lit(".new"))).alias("domain"), F.when(F.col("pos") % 4 == 2, ~F.col("isEnabled")).alias("isEnabled"))
    added = s.where("pos % 3 = 0").select(F.concat("id", F.lit("_b")).alias("id"), F.concat(F.lit("added."), "domain").alias("domain"), F.lit(False).alias("isEnabled"))
    return stores.merge_state(s.drop("pos"), changed.unionByName(added), "id")


@query("WITH g AS (SELECT sourcePlatform, receivedAt, CASE WHEN receivedAt - lag(receivedAt) OVER (PARTITION BY sourcePlatform ORDER BY receivedAt) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS b FROM stack WHERE sourcePlatform IS NOT NULL AND receivedAt IS NOT NULL), h AS (SELECT *, sum(b) OVER (PARTITION BY sourcePlatform ORDER BY receivedAt ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT sourcePlatform, min(receivedAt) AS \"start\", max(receivedAt) + INTERVAL 5 MINUTE AS \"end\", count(*) AS n FROM h GROUP BY sourcePlatform, k")
def arrival_bursts(spark, d):
    """Bursts of arrivals by session window."""
    from quillstream.streaming.feed import bursts

    return bursts(stack(spark, d).where("sourcePlatform is not null and receivedAt is not null"))


@query(f"SELECT CAST(date_trunc('day', receivedAt) AS TIMESTAMP) AS \"start\", {TAG} AS tag, count(*) AS n FROM stack WHERE receivedAt IS NOT NULL GROUP BY ALL")
def counts_by_day(spark, d):
    """R2, A2: counts by day and tag, as the streaming query keeps them."""
    from quillstream.streaming.feed import counts_by_tag

    return counts_by_tag(stack(spark, d).where("receivedAt is not null"))


@query(
    """WITH t AS (SELECT sourceUrl, coalesce(text, '') AS text, min(seq) AS seq FROM stack WHERE regexp_matches(sourceUrl, '^https?://') GROUP BY ALL),
    f AS (SELECT sourceUrl, list_reduce(list([text, '1'] ORDER BY seq), lambda a, x: CASE WHEN contains(a[1], x[1]) THEN a ELSE [a[1] || chr(10) || chr(10) || x[1], CAST(CAST(a[2] AS INT) + 1 AS VARCHAR)] END) AS m FROM t GROUP BY 1)
    SELECT sourceUrl, m[1] AS text, CAST(m[2] AS BIGINT) AS n_texts FROM f"""
)
def stream_upserts(spark, d):
    """R2: the merge by URL as a stream over the stack's files, read to the end; its last state of every URL."""
    import uuid

    from quillstream.session import cut, ensure_checkpoint_dir, remove
    from quillstream.streaming.feed import read_posts, run_once, upserts

    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    at = f"{base}/stream-{uuid.uuid4()}"
    rows = stack(spark, d)
    alone = rows.inputFiles()[0].endswith("/stack.parquet")  # a single file is read by its folder
    stream = read_posts(spark, d, rows.schema, only="stack.parquet") if alone else read_posts(spark, f"{d}/stack.parquet", rows.schema)
    try:
        run_once(upserts(stream), lambda b, _: b.write.mode("append").parquet(f"{at}/out"), f"{at}/state", "update")
        return cut(spark.read.parquet(f"{at}/out").groupBy("sourceUrl").agg(F.max_by("text", "n_texts").alias("text"), F.max("n_texts").alias("n_texts")))
    finally:
        remove(spark, at)
