"""Changes of the configuration against a plain fold, and the feed's operators on hard rows."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.operators import authors as A
from quillstream.operators import classify as C
from quillstream.operators import feed as O
from quillstream.operators.settings import after_changes
from quillstream.sources import stores


def test_changes_against_a_fold(spark):
    rnd = random.Random(7)
    rows = [(f"t{k}", rnd.random() < 0.5) for k in range(30)]
    changes = [(f"{rnd.choice('tT')}{rnd.randrange(45)}", rnd.choice(["add", "remove", "toggle"]), at) for at in range(400)] + [(None, "add", 999)]
    state = {k: [k, v] for k, v in rows}
    for key, op, _ in changes[:-1]:
        low = key.lower()
        if op == "add" and low not in state:
            state[low] = [low, True]
        elif op == "remove":
            state.pop(low, None)
        elif op == "toggle" and low in state:
            state[low][1] = not state[low][1]
    df, ch = spark.createDataFrame(rows, "label string, isEnabled boolean"), spark.createDataFrame(changes, "label string, op string, at long")
    got = {r["label"].lower(): r["isEnabled"] for r in after_changes(df, ch, ("label",), folded=True).collect()}
    assert got == {k: v for k, (_, v) in state.items()}
    assert after_changes(df, ch.limit(0), ("label",)).count() == 30 and after_changes(df.limit(0), ch.limit(0), ("label",)).count() == 0


def test_author_pairs_against_all_pairs(spark):
    rnd = random.Random(4)
    base = ["Johnathan Doe", "Maria Kowalska", "Al", "Li Wei", "Anneliese Schmidt", "Bo", "@anneliese_s", "12345", "Peter Petersen Petersen"]
    rows = []
    for k in range(120):
        n = list(rnd.choice(base))
        for _ in range(rnd.randrange(4)):
            n[rnd.randrange(len(n))] = rnd.choice("abcdeftz ")
        rows.append((k, "".join(n), rnd.choice([None, "", f"https://a.example/@h{rnd.randrange(30)}", "nothing"])))
    rows += [(500, None, "https://a.example/x"), (501, "  ", None)]
    df = spark.createDataFrame(rows, "authorRef long, authorName string, authorUrl string")
    x, y = df.toDF("a", "n", "u"), df.toDF("b", "m", "v")
    want = {tuple(r) for r in x.join(y, F.col("a") < F.col("b")).where(T.author_match(F.col("n"), F.col("m"), F.col("u"), F.col("v"))).select("a", "b").collect()}
    assert {tuple(r) for r in A.author_pairs(df).collect()} == want and want


def test_names_of_many_authors_meet_seldom():
    """Namesakes of one given name meet by segments, all close names do, and no others than those that share one."""
    rnd = random.Random(7)
    names = sorted({"".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randrange(3, 9))) for _ in range(400)})
    for n in list(names[:150]):
        m = list(n)
        for _ in range(rnd.randrange(1, 4)):
            at = rnd.randrange(len(m))
            m[at : at + 1] = rnd.choice(["", rnd.choice("abdik"), m[at] + rnd.choice("abdik")])
        names.append("".join(m))
    names = sorted({n for n in names if len(n) > 3})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, d in enumerate(b):
                last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (c != d))
        return row[-1]

    batch = pa.RecordBatch.from_arrays([pa.array(names)], names=["bare"])
    give, ask, letters = {}, {}, {}
    for r in next(A._segment_batches(iter([batch]))).to_pylist():
        (give if r["longer"] else ask).setdefault(r["key"], set()).add(r["bare"])
        letters[r["bare"]] = r["letters"]
    met = {(x, y) for k, ys in give.items() for y in ys for x in ask.get(k, ())}
    close = {(x, y) for i, x in enumerate(names) for y in names[i + 1 :] if 5 * distance(x, y) < max(len(x), len(y))}
    close = {(x, y) if (len(x), x) < (len(y), y) else (y, x) for x, y in close}
    assert close and close <= met and len(met) < 0.05 * len(names) ** 2
    assert all((letters[x] ^ letters[y]).bit_count() <= 2 * A._edits(len(y)) for x, y in close)


def test_ranges_of_ranges(spark):
    seqs = [0, 1, 4095, 4096, 4097, 4096 * 4096 - 1, 4096 * 4096, 4096 * 4096 * 3 + 5]
    df = spark.createDataFrame([(s, 86_400_000 * (s % 2)) for s in seqs], "seq long, timestamp long")
    assert {r["seq"]: r["position"] for r in O.positions(df).collect()} == {s: k for k, s in enumerate(sorted(seqs, reverse=True))}
    days = [s % 2 for s in sorted(seqs, reverse=True)]
    want = {s for k, s in enumerate(sorted(seqs, reverse=True)) if k == 0 or days[k] != days[k - 1]}
    assert {r["seq"] for r in O.day_separators(df, 86_400_000).collect()} == want
    assert O.day_separators(df.limit(0), 0).count() == 0
    late = spark.createDataFrame([(1, 86_400_000 - 3_600_000)], "seq long, timestamp long")
    assert O.day_separators(late, 86_400_000, "Asia/Tokyo").first()["label"] == "Today"


def test_paused_and_rules(spark):
    df = spark.createDataFrame([("tag", "News"), ("keyword", "News")], "kind string, value string")
    assert O.unless_paused(df, True).count() == 0 and O.unless_paused(df, False).count() == 2
    assert [tuple(r) for r in O.without_values(df, spark.createDataFrame([("tag", "nEWS"), ("keyword", "news")], df.schema)).collect()] == [("keyword", "News")]


def test_corrupt_store_is_seeded(spark, tmp_path):
    schema = spark.createDataFrame([(1, "a")], "id long, name string").schema
    seed = spark.createDataFrame([(9, "seed")], schema)
    (tmp_path / "a.json").write_text('{"id": 1, "name": "x"}\n{"id": 2, "na')
    (tmp_path / "b.json").write_text('{"id": 1, "name": "x"}\n')
    (tmp_path / "c.json").write_text("")
    read = lambda n: [tuple(r) for r in stores.load_json(spark, str(tmp_path / n), schema, seed).collect()]
    assert read("a.json") == [(9, "seed")] and read("b.json") == [(1, "x")] and read("c.json") == [(9, "seed")] and read("none.json") == [(9, "seed")]


def test_tags_of_configuration(spark):
    df = spark.createDataFrame([("Tech", None, True, False, 1), ("Ads", None, True, False, 0), ("Boats", "about ferries", True, True, 2), ("Old", None, False, False, 3)], "label string, prompt string, isEnabled boolean, isDynamic boolean, pos int")
    words = spark.createDataFrame([("Tech", "python")], "label string, keyword string")
    assert [t.label for t in C.tags_of(df)] == ["Tech", "Boats"] and [t.label for t in C.tags_of(df, dynamic=True)] == ["Boats"]
    assert C.tags_of(df, dynamic=False, keywords=words)[0].keywords == ("python",)
    got = C.reclassified(spark.createDataFrame([(1, "python here", "Old", True), (2, "nothing", "Old", False)], "seq long, text string, assignedTag string, isFavorite boolean"), C.tags_of(df, keywords=words), "python")
    assert [(r["seq"], r["assignedTag"], r["isFavorite"]) for r in got.collect()] == [(1, "Tech", True)]


def test_user_prompt(spark):
    df = spark.createDataFrame([("Exploring Bitcoin markets", "linkedin.com"), (None, None)], "t string, p string")
    assert [r[0] for r in df.select(T.user_prompt(F.col("t"), F.col("p"))).collect()] == ['[Source: linkedin.com] "Exploring Bitcoin markets"', '[Source: unknown] ""']


def test_close_names_are_those_of_all_pairs_whatever_the_batches():
    import random

    import pyarrow as pa

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            before, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != d))
        return row[-1]

    rnd = random.Random(4)
    names = ["".join(rnd.choice("abcé") for _ in range(rnd.randrange(5, 28))) for _ in range(30)]
    names += [n[:k] + rnd.choice(["", "x", "xy"]) + n[k + rnd.randrange(2) :] for n in names for k in (1, len(n) // 2)] + ["a" * 600, "a" * 595 + "b" * 6]
    names = sorted({n for n in names if len(n) > 3})
    rows = [(n, A._letters(n), key, longer) for key in ("k", "l", "m") for n in names for longer in (False, True) if len(n) < 100 or key == "l"]
    table = pa.table(dict(zip(("bare", "letters", "key", "longer"), map(list, zip(*rows)))))
    want = {(x, y) for x in names for y in names if x != y and len(x) <= len(y) and abs(len(x) - len(y)) <= 120 and distance(x, y) <= A._edits(len(y))}
    for size, most in ((7, 50), (10_000, 50), (150, 1 << 18)):
        got = {(r["x"], r["y"]) for b in A._near_batches(iter(table.to_batches(size)), most) for r in b.to_pylist()}
        assert {(x, y) for x, y in got if len(x) <= len(y)} == want and ("a" * 600, "a" * 595 + "b" * 6) in got
