"""The queries of this subpackage, by problem, over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import cut_texts, encode, encoding, leaks, names, near_copies, personal, subjects, text_form
from quillstream.session import cut, read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts whose text was cut off."""
    return cut_texts.cut_off(read_table(spark, sf_dir, "stack")).select("seq")


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each platform cuts texts."""
    return cut_texts.rates(read_table(spark, sf_dir, "stack"))


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subjects(read_table(spark, sf_dir, "stack"), read_table(spark, sf_dir, "subject_examples"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject areas of each post."""
    return _subjects(spark, sf_dir).select("seq", "subject")


def p2_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by subject area: posts about each and their share of all posts with a subject."""
    found = cut(_subjects(spark, sf_dir))
    n = found.select("seq").distinct().count()
    return found.groupBy("subject").agg(F.count("*").alias("n_posts")).withColumn("share", F.col("n_posts") / F.lit(max(n, 1)))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of authors that are the same person or organisation."""
    return names.same(read_table(spark, sf_dir, "authors"))


def p3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity of every author, known by one of its authorRefs."""
    return names.entities(read_table(spark, sf_dir, "authors"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of stack.text and stack.authorName that aren't in the consistent form."""
    return text_form.inconsistent_values(read_table(spark, sf_dir, "stack"), "seq", ["text", "authorName"]).select("seq", "field")


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text and author name of stack that looks like another or isn't in the consistent form, with that form."""
    return text_form.skeleton_groups(read_table(spark, sf_dir, "stack"), "seq", ["text", "authorName"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of posts whose texts have a similarity of at least 0.5."""
    return near_copies.pairs(read_table(spark, sf_dir, "stack"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of equal texts of every post and the number of similar classes."""
    return near_copies.groups(read_table(spark, sf_dir, "stack"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of personal data in each post."""
    return personal.found(read_table(spark, sf_dir, "stack")).select("seq", "kind").distinct()


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post with its personal data replaced by typed placeholders."""
    return personal.redacted(read_table(spark, sf_dir, "stack"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k, without special tokens."""
    return encode.token_ids(read_table(spark, sf_dir, "documents"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the items of which they hold at least 12 consecutive words."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each leaked item was found, how much of it, and how often with its answer."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("run").alias("longest_run"), F.count_if("answer").alias("n_with_answer"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that show characters of a wrong decoding."""
    return encoding.garbled(read_table(spark, sf_dir, "documents"))


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents with their text restored where possible."""
    return encoding.restored(read_table(spark, sf_dir, "documents"))


def queries() -> dict:
    """All queries of this subpackage."""
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


_GRAMS = r"""SELECT {key}, unnest(list_distinct(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' ')))) AS g FROM (SELECT {key}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) >= 12"""
_LEAKED = f"WITH d AS ({_GRAMS.format(key='doc_id', table='documents')}), i AS ({_GRAMS.format(key='item_id', table='eval_items')})"


_ITEMS = r"""WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL), iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w, regexp_extract_all(lower(coalesce(answer, '')), '[\p{L}\p{N}]+') AS a FROM eval_items WHERE text IS NOT NULL),
    d AS (SELECT doc_id, unnest(range(1, len(w) - 10)) AS k, w FROM dw WHERE len(w) >= 12), dg AS (SELECT doc_id, k, array_to_string(w[k:k + 11], ' ') AS g FROM d), i AS (SELECT item_id, unnest(range(1, len(w) - 10)) AS k, w FROM iw WHERE len(w) >= 12), ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM i),
    m AS (SELECT DISTINCT doc_id, item_id, k FROM dg JOIN ig USING (g)), s AS (SELECT doc_id, item_id, k - row_number() OVER (PARTITION BY doc_id, item_id ORDER BY k) AS isle FROM m), r AS (SELECT doc_id, item_id, isle, count(*) + 11 AS run FROM s GROUP BY ALL), l AS (SELECT doc_id, item_id, max(run) AS run FROM r GROUP BY ALL)
    SELECT l.item_id, count(*) AS n_docs, CAST(max(run) AS INT) AS longest_run, count(*) FILTER (len(a) > 0 AND contains(' ' || array_to_string(dw.w, ' ') || ' ', ' ' || array_to_string(a, ' ') || ' ')) AS n_with_answer FROM l JOIN dw USING (doc_id) JOIN iw USING (item_id) GROUP BY 1"""


def oracle_sql() -> dict[str, str]:
    """SQL twins, where SQL can express the operator."""
    return {
        "p8_found": f"{_LEAKED} SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (g)",
        "p8_items": _ITEMS,
    }
