"""Keyword classification of posts: scores, ranked tags, the match gate and the cascade of tiers."""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from quillstream.config import Tag, significant_keywords, significant_phrases, tag_keywords
from quillstream.functions.text import clean_tag_name, noun_topic

#: Configuration tables hold a few rows by nature; beyond so many they are refused.
MOST_TAGS = 10_000


def tags_of(df: DataFrame, enabled: bool = True, dynamic: bool | None = None, keywords: DataFrame | None = None) -> list[Tag]:
    """Tags from a configuration table (label, prompt, isEnabled, isDynamic, pos), in its order; `Ads` is a facet, no class.

    `dynamic` picks the tags made from topics or the others. `keywords` (label, keyword) replaces generated keywords.
    """
    rows = df.where(F.coalesce("isEnabled", F.lit(False)) == enabled).where("label <> 'Ads'")
    if dynamic is not None:
        rows = rows.where(F.coalesce("isDynamic", F.lit(False)) == dynamic)
    own: dict[str, list[str]] = {}
    for r in keywords.where("keyword is not null").limit(MOST_TAGS).collect() if keywords is not None else ():
        own.setdefault(r["label"], []).append(r["keyword"])
    found = rows.orderBy("pos", "label").limit(MOST_TAGS + 1).collect()
    if len(found) > MOST_TAGS:
        raise ValueError(f"a configuration of more than {MOST_TAGS} tags")
    return [Tag(r["label"], r["prompt"], r["pos"], tuple(own.get(r["label"], ()))) for r in found]


_SCORE = StructType([StructField("score", IntegerType()), StructField("rank", IntegerType()), StructField("name", StringType()), StructField("share", DoubleType()), StructField("hits", ArrayType(StringType()))])
Scored = list[tuple[int, int, str, float, list[str]]]


class Scorer:
    """All keywords of a list of tags in one automaton."""

    def __init__(self, tags: list[Tag]) -> None:
        self.labels = [t.label for t in tags]
        # keyword: the tags that have it, its weight and its place among the tag's keywords
        self.owners: dict[str, list[tuple[int, int, int]]] = {}
        for t, tag in enumerate(tags):
            for k, (w, x) in enumerate(tag_keywords(tag)):
                self.owners.setdefault(w, []).append((t, x, k))

    def __call__(self, low: str | None) -> Scored:
        """(score, -place of the tag, name, share of the greatest score, hits) of the tags with a hit, best first."""
        if not low or not self.owners:
            return []
        sums: dict[int, int] = {}
        hits: dict[int, list[tuple[int, str]]] = {}
        for w in {w for _, w in _automaton(tuple(self.owners)).iter(low)}:
            for t, x, k in self.owners[w]:
                sums[t] = sums.get(t, 0) + x
                hits.setdefault(t, []).append((k, w))
        best = sorted(sums, key=lambda t: (-sums[t], t))
        # shares to two places, halves up
        return [(sums[t], -t, self.labels[t], (200 * sums[t] + sums[best[0]]) // (2 * sums[best[0]]) / 100, [w for _, w in sorted(hits[t])]) for t in best]


@lru_cache(maxsize=8)
def _automaton(keys: tuple[str, ...]) -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for w in keys:
        auto.add_word(w, w)
    auto.make_automaton()
    return auto


def _array(rows: list[Scored]) -> pa.Array:
    ends = lambda c: pa.array(np.r_[0, np.cumsum(c)].astype(np.int32))
    flat = [x for r in rows for x in r]
    hits = pa.ListArray.from_arrays(ends([len(x[4]) for x in flat]), pa.array([w for x in flat for w in x[4]], pa.string()))
    cols = [pa.array([x[k] for x in flat], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.float64()))]
    return pa.ListArray.from_arrays(ends([len(r) for r in rows]), pa.StructArray.from_arrays([*cols, hits], names=["score", "rank", "name", "share", "hits"]))


def tag_scores(text: Column, tags: list[Tag]) -> Column:
    """Array of (score, rank, name, share, hits) of the tags with a hit, best first, ties in tag order; `share` is the score
    divided by the greatest.

    Keywords are substrings of the text in lower case; all are found in one pass of an automaton, as an Arrow function.
    Nothing is joined or shuffled. A null text has no hits.
    """
    scorer = Scorer(tags)

    @F.arrow_udf(ArrayType(_SCORE))
    def scored(texts: pa.Array) -> pa.Array:
        return _array([scorer(low) for low in texts.to_pylist()])

    return scored(F.lower(text))


def top_tags(scores: Column, n: int = 3) -> Column:
    """The best `n` tags with their shares."""
    return F.slice(scores, 1, n)


def merged(first: Scored, second: Scored, n: int = 3) -> Scored:
    """Two ranked lists, each normalised to its own greatest score, as one: by share, then list, then place; a name once."""
    both = sorted([*first[:n], *second[:n]], key=lambda x: -x[3])
    return [x for k, x in enumerate(both) if x[2] not in {y[2] for y in both[:k]}][:n]


def merged_tags(text: Column, tags: list[Tag], dynamic: list[Tag]) -> Column:
    """The three best of the tags and of the dynamic tags, as `tag_scores` gives them."""
    own, more = Scorer(tags), Scorer(dynamic)

    @F.arrow_udf(ArrayType(_SCORE))
    def scored(texts: pa.Array) -> pa.Array:
        return _array([merged(own(low), more(low)) for low in texts.to_pylist()])

    return scored(F.lower(text))


def matches(text: Column, prompt: str | None) -> Column:
    """Match gate: true without a prompt, with a phrase of it, or with two of its keywords (one if it has one)."""
    if not prompt or not prompt.strip():
        return F.lit(True)
    low = F.lower(text)
    phrases, words = significant_phrases(prompt), significant_keywords(prompt)
    hit = F.lit(False)
    for p in phrases:
        hit = hit | F.contains(low, F.lit(p))
    if words:
        n = sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
        hit = hit | (n >= min(2, len(words)))
    return F.coalesce(hit, F.lit(False))


def classify(df: DataFrame, tags: list[Tag], text: str = "text", dynamic: list[Tag] | None = None) -> DataFrame:
    """`df` with `category`, `tags` and the `tier` that decided.

    First the tags' keywords, with those of the dynamic tags as a second list of its own maximum: the three best of both.
    Else the topic of the text, which is a tag's own label where it is equal to one whatever its case. Else Unclassified.
    """
    out = df.withColumn("_scored", merged_tags(F.col(text), tags, dynamic or []))
    topic = clean_tag_name(noun_topic(F.when(F.size("_scored") == 0, F.col(text))))
    out = out.withColumn("_topic", topic)
    known = F.coalesce(*[F.when(F.lower("_topic") == t.label.lower(), F.lit(t.label)) for t in [*tags, *(dynamic or [])]], F.col("_topic"))
    best = F.get("_scored", F.lit(0))
    out = out.withColumn("category", F.coalesce(best["name"], known, F.lit("Unclassified"))).withColumn("hits", F.coalesce(best["hits"], F.array().cast("array<string>")))
    out = out.withColumn("tags", F.transform("_scored", lambda x: F.struct(x["name"].alias("name"), x["share"].alias("score"))))
    return out.withColumn("tier", F.when(F.size("_scored") > 0, "keywords").when(F.col("category") != "Unclassified", "topic").otherwise("none")).drop("_scored", "_topic")


def reclassified(posts: DataFrame, tags: list[Tag], prompt: str | None = None, dynamic: list[Tag] | None = None) -> DataFrame:
    """All posts after a change of tags or prompt: those that the match gate no longer lets through go, the others are
    classified anew. Favourites and all other columns stay."""
    kept = posts.where(matches(F.col("text"), prompt))
    return classify(kept, tags, dynamic=dynamic).withColumn("assignedTag", F.col("category")).drop("category")


def prompt_tags(text: str | None, n: int = 3) -> list[str]:
    """Tags that a free prompt names, without a model: its topic as a tag name, none if it has none."""
    from quillstream.functions.text import topic_of

    topic = topic_of(text)
    name = " ".join(w[:1].upper() + w[1:].lower() for w in "".join(c for c in topic if c.isascii() and (c.isalnum() or c in "_- ")).split())[:20].strip() if topic else ""
    return [name][:n] if name else []
