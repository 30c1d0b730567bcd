"""Word alignment, vocabulary bounds and audit samples against brute force."""

import itertools
import random

from pyspark.sql import functions as F

from colloquy.functions import edits as E
from colloquy.operators import deleak as D


def common(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        rows[i + 1][j + 1] = rows[i][j] + 1 if a[i] == b[j] else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def applied(a, spans):
    out, i = [], 0
    for s in spans:
        out += a[i : s["at"]]
        i = max(i, s["at"])
        words = s["words"].split()
        if s["kind"] == "removed":
            assert a[i : i + len(words)] == words
            i += len(words)
        else:
            out += words
    return out + a[i:]


def test_scripts_are_shortest_and_lead_to_the_text():
    rng = random.Random(3)
    for _ in range(1500):
        letters = "ab" if rng.random() < 0.5 else "abcdefgh"
        a, b = ([rng.choice(letters) for _ in range(rng.randrange(14))] for _ in range(2))
        found = E.spans(a, b)
        assert applied(a, found) == b
        assert sum(len(s["words"].split()) for s in found) == len(a) + len(b) - 2 * common(a, b)
    for n in (63, 64, 65, 300):
        a, b = ([rng.choice("abc") for _ in range(n)] for _ in range(2))
        assert applied(a, E.spans(a, b)) == b and len(E.kept_words(a, b)) == common(a, b)


def test_long_texts():
    a = [str(i % 5000) for i in range(60_000)]
    b = [w for i, w in enumerate(a) if i % 3]
    found = E.spans(a, b)
    assert applied(a, found) == b and len(found) == 20_000


def test_spans_of_rows(spark):
    rows = [(0, "a b\tc  d", "a c d e"), (1, None, "x"), (2, "x", None), (3, "", "y z"), (4, "y", " "), (5, "same", "same"), (6, "", "")]
    out = spark.createDataFrame(rows, "i int, b string, a string").select("i", E.edit_spans(F.col("b"), F.col("a")).alias("s")).orderBy("i").collect()
    assert [None if r.s is None else [tuple(s) for s in r.s] for r in out] == [[("removed", 1, "b"), ("added", 4, "e")], None, None, [("added", 0, "y z")], [("removed", 0, "y")], [], []]
    listed = spark.createDataFrame([(0, "a b c d", "c", ["a  b"]), (1, "a b c d", "c", None), (2, "ab c", "c", ["xab"])], "i int, b string, a string, l array<string>")
    out = listed.select("i", E.unlisted(E.edit_spans(F.col("b"), F.col("a")), F.col("l")).alias("u")).orderBy("i").collect()
    assert [r.u for r in out] == [["d"], ["a b", "d"], ["ab"]]


def test_words_outside_the_vocabulary(spark):
    edits = spark.createDataFrame([(1, "c1", "Does Therapy help the zebra now"), (2, "c2", "therapy"), (3, None, "thing other"), (4, "c1", None), (5, "c1", ""), (6, "gone", "word word")], "id int, case string, text string")
    sources = spark.createDataFrame([("c1", "therapy does"), ("c1", "HELP, now"), (None, "a thing"), ("c1", None), ("c2", "no")], "case string, text string")
    out = {r.id: r.outside for r in D.outside_vocabulary(edits, ["id"], "case", "text", sources).collect()}
    assert out == {1: ["zebra"], 2: ["therapy"], 3: ["other"], 4: [], 5: [], 6: ["word"]}
    assert D.outside_vocabulary(edits.where("false"), ["id"], "case", "text", sources).count() == 0
    q = spark.createDataFrame([("paraphrase", "a b?", "new b?", "why", ["new"]), ("paraphrase", "a b?", "b?", "why", []), ("paraphrase", "a b?", "b?", "why", None)], "v string, b string, a string, r string, o array<string>")
    assert [r[0] for r in q.select(D.question_holds(*map(F.col, "vbar"), F.col("o"))).collect()] == [False, True, True]


def test_samples_are_the_least_hashes_whatever_the_partitions(spark):
    import hashlib

    rows = [(i, "hot" if i % 3 else ["x", "y", None][i % 9 // 3]) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, s string")
    want = set()
    for s in ("hot", "x", "y", None):
        ids = sorted((i for i, t in rows if t == s), key=lambda i: hashlib.sha256(f"seed:{i}".encode()).hexdigest())
        want |= set(ids[: {"hot": 50, "y": 0}.get(s, 20)])
    for n in (1, 7):
        for spread in (1, 256):
            got = D.bottom_by_hash(df.repartition(n), "s", "id", {"hot": 50, "y": 0}, 20, "seed", spread)
            assert {r.id for r in got.collect()} == want and got.columns == ["id", "s"]
    small = D.bottom_by_hash(df, "s", "id", {}, 5, "seed")
    assert {r.id for r in small.collect()} <= {r.id for r in D.bottom_by_hash(df, "s", "id", {}, 9, "seed").collect()}
    assert D.bottom_by_hash(df, "s", "id", {}, 5000, "seed").count() == 3000
    assert D.bottom_by_hash(df.where("false"), "s", "id", {}, 5).count() == 0


def test_audit(spark):
    rows = [(i, "drop" if i % 10 == 0 else None if i % 10 == 9 else "keep", "abc"[i % 3]) for i in range(300)]
    verdicts = spark.createDataFrame(rows, "id int, verdict string, type string")
    sample = D.audit_sample(verdicts, "type", "id", {"a": 30}, 10)
    got = sample.collect()
    assert sorted(r.id for r in got if not r.kept) == [i for i in range(300) if i % 10 in (0, 9)]
    assert len([r for r in got if r.kept]) == 50 and all(r.verdict == "keep" for r in got if r.kept)
    classes = sample.withColumn("class", F.when(F.col("type") == "a", F.when(F.col("id") % 2 == 0, "C").otherwise("A")).when(F.col("type") == "b", "B"))
    out = {r.type: r for r in D.audit_report(verdicts, classes, "type").collect()}
    assert out["a"].keeps == 80 and out["a"].sampled == 30 and 0 < out["a"].repaired < 30 and out["a"].rate == out["a"].repaired / 30
    assert (out["b"].sampled, out["b"].repaired, out["b"].rate) == (10, 0, 0.0) and (out["c"].sampled, out["c"].rate) == (0, None)
