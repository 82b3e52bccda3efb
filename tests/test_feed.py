"""Operators of the feed on small fixtures, with nulls, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from quillstream.operators import authors as A
from quillstream.operators import feed as O
from quillstream.operators import state as S
from quillstream.sources import pages, stores

SCHEMA = "seq long, id string, text string, sourcePlatform string, sourceUrl string, authorName string, authorUrl string, assignedTag string, timestamp long, isAd boolean, isFavorite boolean, label string, _value string"
ROWS = [
    (1, "a", "one", "x.com", "https://x.com/post1", "Ann", None, "Tech", 1000, False, False, "l", "v"),
    (2, "b", "two", "www.youtube.com", "https://youtube.com/1", "Bob", None, "tech", 3000, None, True, "l", "v"),
    (3, "c", "one", "m.youtube.com ", "https://x.com/post2", "", None, None, 2000, True, None, "l", "v"),
    (4, "d", None, None, None, None, None, "News", 2000, None, None, None, None),
    (5, "e", "", "TWITTER.com", "https://x.com/post1", "Ann", None, "News", 90_000_000, False, True, None, None),
    (6, "e", "one more", "x.com", "https://x.com/post1", "Ann", None, "Tech", 90_000_000, True, False, None, None),
]


@pytest.fixture(scope="module")
def posts(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def seqs(df):
    return sorted(r["seq"] for r in df.collect())


def rules(spark, *rows):
    return spark.createDataFrame(list(rows), "kind string, value string")


def test_ignore_rules(spark, posts):
    assert seqs(O.without_ignored(posts, rules(spark, ("tag", "TECH")))) == [3, 4, 5]
    assert seqs(O.without_ignored(posts, rules(spark, ("link", "https://x.com/post2")))) == [1, 2, 4, 5, 6]
    assert seqs(O.without_ignored(posts, rules(spark, ("domain", "YouTube.com")))) == [1, 4, 5, 6]
    assert seqs(O.without_ignored(posts, rules(spark, ("keyword", "MORE")))) == [1, 2, 3, 4, 5]
    assert seqs(O.without_ignored(posts, rules(spark, ("keyword", "more")), keywords=False)) == [1, 2, 3, 4, 5, 6]
    assert seqs(O.without_ignored(posts, rules(spark).limit(0) if False else rules(spark, ("other", "x")))) == [1, 2, 3, 4, 5, 6]


def test_sites(spark, posts):
    sites = spark.createDataFrame([("s", "x.com", True, 0), ("t", "youtube.com", True, 1), ("w", "*", False, 2)], "id string, domain string, isEnabled boolean, pos int")
    got = {r["seq"]: r["site"] for r in O.with_site(posts, sites).collect()}
    assert got == {1: "x.com", 2: "youtube.com", 3: "youtube.com", 4: "Other", 5: "x.com", 6: "x.com"}
    assert seqs(O.site_enabled(posts, sites)) == [1, 2, 3, 5, 6]
    assert seqs(O.site_enabled(posts, sites.withColumn("isEnabled", F.lit(True)))) == [1, 2, 3, 4, 5, 6]


def test_views(posts):
    assert seqs(O.by_tag(posts, None)) == [1, 2, 3, 4, 5, 6]
    assert seqs(O.by_tag(posts, "Favorites")) == [2, 5]
    assert seqs(O.by_tag(posts, "Ads")) == [3, 6]
    assert seqs(O.by_tag(posts, "Unclassified")) == [3]
    assert seqs(O.search(posts, " MORE ")) == [6]
    assert seqs(O.cleared(posts, "News")) == [1, 2, 3, 5, 6]
    facets = {r["facet"]: r["n"] for r in O.category_facets(posts).collect()}
    assert facets == {"All": 6, "Favorites": 2, "Ads": 2, "Tech": 2, "tech": 1, "Unclassified": 1, "News": 2}


def test_order(spark, posts):
    assert {r["seq"]: r["position"] for r in O.positions(posts).collect()} == {6: 0, 5: 1, 4: 2, 3: 3, 2: 4, 1: 5}
    labels = {r["seq"]: r["label"] for r in O.day_separators(posts, 90_000_000).collect()}
    assert labels == {6: "Today", 4: "Yesterday"}
    big = spark.range(1, 10_001).select(F.col("id").alias("seq"), (F.col("id") * 1000).alias("timestamp"))
    assert O.positions(big).where("position <> 10000 - seq").count() == 0
    assert [r["author"] for r in O.top_authors(posts).collect()] == ["Ann", "Bob"]


def test_mutations(spark, posts):
    acts = spark.createDataFrame([(1, 1, "FAVORITE_TOGGLED", None, 1), (1, 1, "FAVORITE_TOGGLED", None, 1), (2, 2, "FAVORITE_TOGGLED", None, 1), (3, 3, "ITEM_RETAGGED", "X", 1), (4, 3, "ITEM_RETAGGED", "Y", 2), (5, 4, "ITEM_DELETED", None, 1), (6, None, "ITEM_DELETED", None, 1)], "actionId long, seq long, kind string, newTag string, actedAt long")
    got = {r["seq"]: (r["assignedTag"], r["isFavorite"]) for r in O.after_mutations(posts, acts).collect()}
    assert got[1] == ("Tech", True) and got[2] == ("tech", False) and got[3] == ("Y", False) and 4 not in got


def test_dedup_and_upsert(posts):
    assert seqs(O.dedup(posts)) == [1, 2, 4, 5, 6]
    got = {(r["sourceUrl"], r["seq"]): (r["text"], r["isAd"]) for r in S.upsert_by_url(posts).collect()}
    assert got[("https://x.com/post1", 6)] == ("one\n\none more", True)
    assert got[(None, 4)][0] is None and len(got) == 4
    assert S.merge_texts(["a", "a", "b", None]) == ("a\n\nb", 1)


def test_empty(spark, posts):
    none = posts.limit(0)
    assert O.dedup(none).count() == O.positions(none).count() == O.day_separators(none, 0).count() == S.upsert_by_url(none).count() == 0
    assert O.category_facets(none).count() == 0


def test_authors_against_brute_force(spark):
    names = [(1, "John Doe", None), (2, "john doe", ""), (3, "John-Doe 77", None), (4, "Johnathan Doe", None), (5, "Johnathon Doe", None), (6, "Al", None), (7, "al", None), (8, None, None), (9, "", None), (10, "Zed", "https://x.com/q"), (11, "Other", "https://y.com/in/Q/")]
    df = spark.createDataFrame(names, "authorRef long, authorName string, authorUrl string")
    from quillstream.functions.text import author_match

    both = df.toDF("a", "na", "ua").crossJoin(df.toDF("b", "nb", "ub")).where("a < b").where(author_match(F.col("na"), F.col("nb"), F.coalesce("ua", F.lit("")), F.coalesce("ub", F.lit(""))))
    assert sorted(map(tuple, A.author_pairs(df).collect())) == sorted((r["a"], r["b"]) for r in both.collect())
    canon = {r[0]: r[1] for r in A.canonical_names(df).collect()}
    assert canon[2] == "John Doe" and canon[8] is None and canon[9] == ""


def test_canonical_names_against_a_fold(spark):
    rows = [
        (1, "Daily News", None), (2, "The Daily News", None), (3, "Jon Smith", None), (4, "John Smith", None), (5, "Ann Lee", "https://x.com/@q7?ref=feed"), (6, "Boris", "https://y.com/in/q7/"),
        (7, "Smith", None), (8, "John Smithers", None), (9, "Al", None), (10, "al", None), (11, "Borisov", None), (12, None, None), (13, "", None), (14, "Zed", "no url"), (15, "daily news", None), (16, "Boris", "https://y.com/in/q7/"),
    ]
    rows += [(20 + k, f"{'abcdefgh'[k % 8] * 2}{'mnopq'[k % 5]}{'harbour'[: 3 + k % 5]}{'xyz'[k % 3]}", f"https://z.com/u{k % 23}" if k % 2 else None) for k in range(80)]
    df = spark.createDataFrame(rows, "authorRef long, authorName string, authorUrl string")
    from quillstream.functions.text import author_match

    both = df.toDF("a", "na", "ua").crossJoin(df.toDF("b", "nb", "ub")).where("a < b").where(author_match(F.col("na"), F.col("nb"), F.coalesce("ua", F.lit("")), F.coalesce("ub", F.lit(""))))
    match = {(r["a"], r["b"]) for r in both.collect()}
    known, want = [], {}
    for ref, name, _ in rows:
        got = next((k for k in known if (k, ref) in match), None)
        if got is None:
            known.append(ref)
        want[ref] = name if got is None else want[got]
    assert {r[0]: r[1] for r in A.canonical_names(df).collect()} == want
    assert {tuple(r) for r in A.author_pairs(df).collect()} == match
    assert want[2] == "Daily News" and want[4] == "Jon Smith" and want[6] == "Ann Lee" and want[11] == "Borisov"
    assert A.canonical_names(df.limit(0)).count() == 0


def test_pages(spark):
    html = '<html><body><nav>Home</nav><article class="post"><h2>Sponsored</h2><a rel="author" href="/u/ann">Ann</a><p>A long enough text about the harbour and its ferries, written for this test.</p><a href="/status/5">link</a></article><article><p>short</p></article></body></html>'
    df = spark.createDataFrame([(1, "https://www.chirrup.example/home", html), (2, "u", None), (3, None, "")], "page_id long, url string, html string")
    (r,) = pages.posts_of_pages(df).collect()
    assert (r["page_id"], r["sourcePlatform"], r["sourceUrl"], r["authorName"], r["isAd"]) == (1, "chirrup.example", "https://www.chirrup.example/status/5", "Ann", True)


def test_triples_and_late_card_links(spark):
    from quillstream.functions.text import ngrams

    df = spark.createDataFrame([("Yield curve inversion, the harbour",)], "text string")
    assert df.select(ngrams(F.col("text"))).first()[0] == ["yield curve", "yield curve inversion", "curve inversion"]
    html = "<div>" + "".join(f'<a href="/{k}">{k}</a> ' for k in range(4)) + '<a href="/t">A title of more than twenty letters</a> and some more words beside it</div>'
    assert len(pages.extract(html, "https://a.example/")) == 1


def test_stores(spark, posts, tmp_path):
    path = str(tmp_path / "s")
    keep = posts.select("seq", "text", "assignedTag")
    stores.save_json(keep, path)
    assert stores.load_json(spark, path, keep.schema).count() == 6
    assert stores.load_json(spark, str(tmp_path / "none"), keep.schema, keep.limit(1)).count() == 1
    stores.export_csv(posts, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "csv"))
    assert back.count() == 6 and len(back.columns) == 9
    (m,) = stores.merge_state(keep.where("seq = 1"), keep.where("seq = 1").withColumn("text", F.lit("new")), "seq").collect()
    assert m["text"] == "new"


def test_stream(spark, posts, tmp_path):
    from quillstream.streaming.feed import read_posts, run_once, upserts

    posts.write.parquet(str(tmp_path / "in"))
    stream = read_posts(spark, str(tmp_path / "in"), posts.schema)
    run_once(upserts(stream), lambda b, _: b.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "state"), "update")
    got = {r["sourceUrl"]: r["n_texts"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {"https://x.com/post1", "https://x.com/post2", "https://youtube.com/1"}
