"""Text functions against the known vectors and plain Python."""

import pytest
from pyspark.sql import functions as F

from quillstream.config import Tag, custom_keywords, significant_keywords, significant_phrases
from quillstream.functions import text as T
from quillstream.operators import classify as C


def one(spark, col_of, *values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(col_of(F.col("t"))).collect()]


def test_sanitize(spark):
    got = one(spark, T.sanitize, "Write to john.doe@example.org or info@company.com", "My phone number is +1 (555) 019-2834, call me.", "Charge my card 4111 1111 1111 1111", "Fake number is 4111-1111-1111-1112", "caféjo@x.com", "5551234567@x.com", "", None, "x" * 50_000)
    assert got[:4] == ["Write to [REDACTED_EMAIL] or [REDACTED_EMAIL]", "My phone number is [REDACTED_PHONE], call me.", "Charge my card [REDACTED_CC]", "Fake number is 4111-1111-1111-1112"]
    assert got[4:8] == ["café[REDACTED_EMAIL]", "[REDACTED_PHONE]@x.com", "", None]
    assert got[8] == "x" * 50_000


def test_clean_tag_name(spark):
    assert one(spark, T.clean_tag_name, "artificial   intelligence!!!", "spacex-rocket", "   ", "a" * 30, None) == ["Artificial Intellige", "Spacex-rocket", None, "A" + "a" * 19, None]


def test_noun_topic(spark):
    text = "The company Microsoft showed a new tool. Many said Microsoft was first.\nMicrosoft declined."
    assert one(spark, T.noun_topic, text, "", None, "the of and") == ["Microsoft", None, None, None]


def test_keyword_ranking(spark):
    tags = [
        Tag("Tech", None, 0, ("code", "python", "repository", "software")),
        Tag("Finance", None, 1, ("bond", "yield", "recession")),
        Tag("AI & Machine Learning", None, 2, ("transformers", "language model", "gpu")),
    ]
    texts = ["Her software keeps all python scripts in one place.", "A recession would lift every bond in the drawer.", "Two transformers share a GPU rack.", "Rain again over the allotments.", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(C.top_tags(C.tag_scores(F.col("t"), tags)).alias("x"))
    assert [[y["name"] for y in r["x"]][:1] for r in df.collect()] == [["Tech"], ["Finance"], ["AI & Machine Learning"], [], []]


def test_merged_lists():
    a = [(4, 0, "A", 1.0, []), (2, -1, "B", 0.5, [])]
    b = [(3, 0, "C", 1.0, []), (2, -1, "A", 0.9, [])]
    assert [(x[2], x[3]) for x in C.merged(a, b)] == [("A", 1.0), ("C", 1.0), ("B", 0.5)]
    assert C.merged([], []) == [] and C.merged(a, []) == a


def test_cascade(spark):
    tags, dynamic = [Tag("Tech", None, 0, ("python",))], [Tag("Boats", None, 0, ("ferry",))]
    rows = [("python on a ferry",), ("the ferry left",), ("Tech is what Anna called it; Tech it was.",), ("In the end Lighthouse stayed, Lighthouse",), ("of the and",), (None,)]
    got = [(r["category"], r["tier"], [t["name"] for t in r["tags"]]) for r in C.classify(spark.createDataFrame(rows, "text string"), tags, dynamic=dynamic).collect()]
    assert got == [("Tech", "keywords", ["Tech", "Boats"]), ("Boats", "keywords", ["Boats"]), ("Tech", "topic", []), ("Lighthouse", "topic", []), ("Unclassified", "none", []), ("Unclassified", "none", [])]
    assert C.prompt_tags("show me posts on Lighthouse keepers, Lighthouse") == ["Lighthouse"] and C.prompt_tags(None) == []


def test_prompts(spark):
    assert "yield curve" in significant_phrases('the "yield curve" now')
    assert significant_keywords("the bank and the bank") == ["bank"]
    assert {"cook", "cooker", "cooking", "recipe"} <= set(custom_keywords("Cooking"))
    df = spark.createDataFrame([("a Yield Curve moved",), ("bank news",), ("bank",), (None,)], "t string")
    assert [r[0] for r in df.select(C.matches(F.col("t"), 'the "yield curve" or bank dividend news')).collect()] == [True, True, False, False]
    assert df.select(C.matches(F.col("t"), " ")).distinct().count() == 1


@pytest.mark.parametrize("text,title,body", [("One. Two", "One.", "Two"), ("short", "short", ""), ("y" * 80, "y" * 65 + "…", "y" * 80), ("", "", ""), (None, "", "")])
def test_card(spark, text, title, body):
    df = spark.createDataFrame([(text,)], "t string")
    assert tuple(df.select(T.card_title(F.col("t")), T.card_body(F.col("t"))).first()) == (title, body)


def test_author_match(spark):
    rows = [("John Doe", "john doe", "", "", True), ("@JohnDoe", "john_doe", "", "", True), ("John Doe 123", "John-Doe", "", "", True), ("John Doe", "John D.", "https://x.com/johndoe", "https://linkedin.com/in/johndoe/", True), ("Johnathan Doe", "Johnathan", "", "", True), ("Johnathan Doe", "Johnathon Doe", "", "", True), ("John Doe", "Jane Smith", "https://x.com/johndoe", "https://linkedin.com/in/janesmith", False), ("123", "45", "", "", False), (None, "x", "", "", False), ("", "", "", "", False)]
    df = spark.createDataFrame(rows, "a string, b string, u string, v string, want boolean")
    bad = df.where(T.author_match(F.col("a"), F.col("b"), F.col("u"), F.col("v")) != F.col("want"))
    assert bad.count() == 0


def test_entities(spark):
    df = spark.createDataFrame([("We met #one #two #three and Maria Kowalska", "Courts"), ("", "Courts"), (None, None)], "t string, c string")
    assert [r[0] for r in df.select(T.local_entities(F.col("t"), F.col("c"))).collect()] == [["Courts", "one", "two"], [], []]
