"""Operators against brute force on a small fixture, and on empty tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from colloquy.llm import decontamination, mixing, near_dedup, pitman_yor, quality_rules, substring_dedup, suffix_dedup, url_filters, warc
from colloquy.llm.language_id import identify, learn
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def order(doc_id):
    return -(2**63) if doc_id is None else doc_id


def test_substring_dedup(docs):
    rows = [(order(r.doc_id), r.text or "") for r in docs.collect()]
    first = {}
    for d, t in sorted(rows):
        w = WORD.findall(t)
        for i in range(len(w) - 19):
            first[tuple(w[i : i + 20])] = min(first.get(tuple(w[i : i + 20]), (d, i)), (d, i))
    want = []
    for d, t in rows:
        w = WORD.findall(t)
        gone = {j for i in range(len(w) - 19) if first[tuple(w[i : i + 20])] < (d, i) for j in range(i, i + 20)}
        want.append((None if d == order(None) else d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert rows_of(substring_dedup.dedup_substrings(docs), "doc_id", "n_words", "n_removed", "kept_text") == sorted(want, key=str)


@pytest.mark.parametrize("shard_bytes", [3 << 20, 500])
def test_suffix_dedup(docs, shard_bytes):
    texts = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    seen = Counter(t[i : i + 50] for _, t in texts for i in range(len(t) - 49))
    want = []
    for d, t in texts:
        gone = bytearray(len(t) + 1)
        for i in range(len(t) - 49):
            if seen[t[i : i + 50]] > 1:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t)))
        want.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest()))
    got = suffix_dedup.dedup_strings(docs, window=50, shard_bytes=shard_bytes).withColumn("h", F.sha2("kept_bytes", 256))
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "h") == sorted(want, key=str)


def test_suffix_array_and_common_prefixes():
    text = np.frombuffer(b"banana bandana banana\0\0ba", np.uint8)
    raw = text.tobytes()
    sa = suffix_dedup.suffix_array(text)
    assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    shared = suffix_dedup.common_prefixes(text, sa, np.array([0]), np.array([len(raw)]), 100)
    for k in range(1, len(raw)):
        a, b = raw[sa[k - 1] :], raw[sa[k] :]
        assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def shingles(text, n):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n, percent):
    sets = [(d, shingles(t, n)) for d, t in rows]
    up = {d: d for d, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                lo, hi = sorted((root(a), root(b)))
                up[hi] = lo
    return sorted((d, len(s), root(d)) for d, s in sets)


@pytest.mark.parametrize("bitmap_bytes,block", [(near_dedup.BITMAP_BYTES, near_dedup.BLOCK), (0, 40)])
def test_near_duplicates_in_a_large_group(spark, monkeypatch, bitmap_bytes, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)  # read on the driver
    rnd = random.Random(5)
    base = [f"b{i}" for i in range(260)]
    rows = []
    for d in range(150):  # copies of a text that is not there, some within reach of each other
        w = list(base)
        for i in rnd.sample(range(260), rnd.choice([2, 5, 8, 11])):
            w[i] = f"d{d}x{i}"
        rows.append((d + 10, " ".join(w)))
    rows += [(d + 500, rows[d % 7][1].upper()) for d in range(40)] + [(900, "short one"), (901, "short one"), (902, ""), (903, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(df, words=3, percent=85, bitmap_bytes=bitmap_bytes)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == sorted(brute_components(rows, 3, 85), key=str)


def test_near_duplicates_find_short_texts_close_to_the_limit(spark):
    rnd, rows = random.Random(9), []
    for d in range(0, 900, 2):
        w = [f"v{rnd.randrange(10**6)}" for _ in range(rnd.randrange(8, 60))]
        other = list(w)
        if len(w) > 24:
            other[rnd.randrange(len(w))] = "changed"
        else:
            other = other[1:]
        rows += [(d, " ".join(w)), (d + 1, " ".join(other))]
    want = {d: root for d, _, root in brute_components(rows, 3, 85)}
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()}
    linked = [d for d, root in want.items() if root != d]
    assert len(linked) > 150
    assert sum(got[d] == want[d] for d in linked) >= 0.99 * len(linked)
    assert all(got[d] == d for d, root in want.items() if root == d)


def test_near_duplicates_of_awkward_rows(docs):
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert all(r.component_id == r.doc_id and r.n_shingles == 0 for r in got if r.doc_id in (3, 4, 5))
    assert {r.doc_id: r.component_id for r in got if r.doc_id in (1, 2, 6)} == {1: None, 2: None, 6: 6}


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.9):
        both = rng.integers(0, 2**63, 4000).astype(np.uint64)
        k = int(4000 * (1 - share) / (1 + share))
        a, b = (np.sort(np.concatenate([both[:4000 - k], rng.integers(0, 2**63, k).astype(np.uint64)]) * np.uint64(2)) for _ in range(2))
        regs, _ = near_dedup.registers_of(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(near_dedup.estimated(regs[0], regs[1]) - want) < 0.12


def test_mixing(docs):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == docs.count()
    sizes = Counter()
    for r in got:
        sizes[r.source] += r.size
    total = sum(sizes.values())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left = {}, 1.5 * total
    open_ = set(names)
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
        assert math.floor(r.rate) <= r.copies <= min(2, math.floor(r.rate) + 1)
    again = rows_of(mixing.mix_sources(docs), "doc_id", "copies")
    assert again == rows_of(mixing.mix_sources(docs.repartition(3)), "doc_id", "copies")
    assert mixing.emitted(mixing.mix_sources(docs)).count() == sum(r.copies for r in got)


def test_quality_statistics(docs):
    lines = [(20, "# a|b\n# a|b\n\n \n&amp; $5 *\n# a|b", "", "", 0, ""), (21, "x y\nx y \nx y", "", "", 0, "")]
    docs = docs.unionByName(docs.sparkSession.createDataFrame(lines, docs.schema))
    found = {(r.doc_id, r.n_words): r for r in quality_rules.quality(docs, docs.selectExpr("doc_id", "1 as quality").limit(0)).collect()}
    for r in quality_rules.statistics(docs).collect():
        t = r.text or ""
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = Counter(grams)
        again = {i + k for i, g in enumerate(grams) if twice[g] > 1 for k in range(3)}
        seen, twice_lines = set(), 0
        for line in t.split("\n"):
            twice_lines += bool(WORD.search(line)) and line in seen
            seen.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), twice_lines, len(again))
        one = found[r.doc_id, len(w)]
        assert one.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and one.kept == (not one.base_failed)


def test_rules_find_the_bad_ones(spark):
    rows = [(i, " ".join(("###" if i % 4 == 0 else "word") + str(j) for j in range(60)), int(i % 4 != 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = quality_rules.quality(df, df.select("doc_id", "quality"))
    assert all(r.kept == (r.doc_id % 4 != 0) for r in got.collect())
    assert quality_rules.quality(df, df.select("doc_id", "quality").limit(0)).where("not kept").count() == 0


def test_rules_cover_several_features(spark):
    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    rows = []
    for i in range(1200):
        if i % 6 == 0:  # bad by symbols
            text = " ".join("#" + word(4) for _ in range(60))
        elif i % 6 == 1:  # bad by long words, but only in short texts
            text = " ".join(word(14) for _ in range(60))
        elif i % 6 == 2:  # good: long words in long texts
            text = " ".join(word(14) for _ in range(200))
        else:
            text = " ".join(word(rnd.choice([3, 4, 5, 6])) for _ in range(rnd.choice([60, 100, 200])))
        rows.append((i, text, int(i % 6 > 1)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    known, rest = df.where("doc_id < 800"), df.where("doc_id >= 800")
    stats = quality_rules.statistics(known.select("doc_id", "text")).join(known.select("doc_id", "quality"), "doc_id")
    rules = quality_rules.learn_rules(stats, F.col("quality") == 0)
    assert len(rules) >= 2 and any(len(r.conditions) > 1 for r in rules)
    assert [r.conditions for r in quality_rules.learn_rules(stats.repartition(7), F.col("quality") == 0)] == [r.conditions for r in rules]
    got = quality_rules.judged(quality_rules.statistics(rest.select("doc_id", "text")), rules).select("doc_id", "kept").collect()
    assert sum(r.kept == (r.doc_id % 6 > 1) for r in got) >= 0.97 * len(got)


def test_contamination(docs, spark):
    items = spark.createDataFrame([(1, "W5 w6 w7"), (2, " ".join(f"w{i}" for i in range(30, 50))), (3, None), (4, ""), (5, "not there at all"), (2, "w1")], "item_id long, text string")
    word = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    windows = []
    for r in items.collect():
        w = word.findall((r.text or "").translate(low))
        windows += [(r.item_id, w[i : i + 13]) for i in range(max(1, len(w) - 12))] if w else []
    want = []
    for r in docs.collect():
        w = word.findall((r.text or "").translate(low))
        hit, found = set(), set()
        for item, x in windows:
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit |= set(range(i, i + len(x)))
                    found.add(str(item))
        want.append((r.doc_id, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    got = decontamination.contamination(docs, items)
    assert rows_of(got, "doc_id", "n_words", "n_hit", "items", "contaminated") == sorted(want, key=str)


def test_proximity(spark):
    word = re.compile(r"[a-z0-9]+")
    rnd = random.Random(8)
    texts = [(d, " ".join(rnd.choice([f"c{k % 4}" for k in range(20)] + [f"r{k}" for k in range(9)]) for _ in range(rnd.choice([3, 40, 160])))) for d in range(40)] + [(40, None), (41, "")]
    items = [(1, "r0 c0 r1"), (2, "r2 c1 c1 c2 r3 c3"), (3, "r4"), (4, "r0 nowhere r1"), (5, None), (6, texts[5][1][:40].rsplit(" ", 1)[0])]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {d: set() for d, _ in texts}
    for item, t in items:
        w = word.findall(t or "")
        for x in [w[i : i + 5] for i in range(max(1, len(w) - 4))] if w else []:
            for d, text in texts:
                said = word.findall(text or "")
                if any(set(x) <= set(said[s : s + 9]) for s in range(len(said))):
                    want[d].add(str(item))
    got = decontamination.contamination(docs, bench, window=5, near=9).collect()
    assert {r.doc_id: r.near_items for r in got} == {d: sorted(x) for d, x in want.items()}
    assert all(set(r["items"]) <= set(r.near_items) for r in got) and any(set(r.near_items) - set(r["items"]) for r in got)
    assert "near_items" not in decontamination.contamination(docs, bench, window=5).columns
    docs = spark.createDataFrame([(1, "r0 r1 z0 z1 z2 z3"), (2, "z r3 r1 y r0 R2 x c z"), (3, "r0 r1 r2 z z z z z r3 c")], "doc_id long, text string")
    got = decontamination.contamination(docs, spark.createDataFrame([(7, "r0 r1 r2 r3 c")], "item_id long, text string"), window=5, near=7).collect()
    assert {r.doc_id: r.near_items for r in got} == {1: [], 2: ["7"], 3: []}


def test_language_id(spark):
    texts = {"aa": "the cat and the dog went to the old house ", "bb": "el gato y el perro van a la casa vieja "}
    rows = [(i, texts[lang] * (1 + i % 3), lang) for i, lang in enumerate(["aa", "bb"] * 20)] + [(98, None, "aa"), (99, "12 34", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = identify(df, learn(df)).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got if r.doc_id < 90)
    assert {r.lang_pred for r in got if r.doc_id > 90} == {"und"}
    assert {r.lang_pred for r in identify(df, learn(df.limit(0))).collect()} == {"und"}


def test_warc_round_trip(spark):
    big = "<p>é" + "x" * 1200
    rows = [(1, "http://b.com/x", big), (2, "http://a.com/", big), (3, None, None), (4, "http://a.com/y", "tiny"), (5, "http://a.com/z", "tiny"), (None, "http://c.com", "n\r\n\r\nm")]
    pages = spark.createDataFrame([(*r, "kept") for r in rows], "page_id long, url string, html string, digest string").withColumn("fetched", F.lit("2024-05-01").cast("date"))
    got = {r.page_id: r for r in warc.archived(pages).collect()}
    for page, _, html in rows:
        raw = (html or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert got[page].payload == (None if page == 1 else raw)
    assert (got[1].record_type, got[1].refers_to, got[2].record_type, got[4].record_type) == ("revisit", 2, "response", "response")
    placed = sorted(got.values(), key=lambda r: (r.range, r.place))
    assert [r.page_id for r in placed] == [3, 2, 4, 5, 1, None]


def test_capture_histories_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 5)  # read on the driver
    rows = [(i, f"http://www.h{i % 3 if i % 4 else 0}.com/", "x", f"2024-0{1 + i % 7}-01") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, day string").withColumn("fetched", F.to_date("day")).repartition(4)
    index = warc.merged_index(warc.write_archives(pages.select("page_id", "url", "html", "fetched"), warc.work_dir(spark, "warc")).withColumn("mark", F.lit(True)))
    got = warc.histories(index).collect()
    assert len({r.range for r in got}) > 3
    history = {}
    for r in sorted(rows, key=lambda r: (r[1], r[3], r[0])):
        history.setdefault(r[1], []).append(r[0])
    assert {r.page_id: r.capture for r in got} == {page: i for x in history.values() for i, page in enumerate(x, 1)}


def test_warc_of_an_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string, fetched date")
    assert warc.archived(pages).count() == 0
    assert warc.opened("file:///tmp/x")[1] == "/tmp/x"


def test_loser_tree():
    rnd = random.Random(1)
    for k in (1, 2, 3, 7):
        runs = [sorted(((f"k{rnd.randrange(9)}", "t", rnd.randrange(50), "response", "", "f", i, 0) for i in range(rnd.randrange(6))), key=warc.order_of) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted((r for run in runs for r in run), key=warc.order_of)


def test_url_filters(spark):
    list_ = spark.createDataFrame([("bad.com", "block", "2024-01-10"), ("bad.com", "end", "2024-02-10"), ("ok.bad.com", "allow", "2024-01-15"), (None, "block", "2024-01-01")], "domain string, action string, dated string")
    seen = spark.createDataFrame([("http://x.bad.com/a", "2024-01-09"), ("http://x.BAD.com:80/a", "2024-01-10"), ("http://ok.bad.com", "2024-01-20"), ("http://ok.bad.com", "2024-01-12"), ("http://bad.com", "2024-02-10"), (None, "2024-01-20"), ("http://bad.com", None)], "url string, day string")
    got = url_filters.filtered(seen.select("url", F.to_date("day").alias("fetched"), F.lit("x").alias("host")), list_.select("domain", "action", F.to_date("dated").alias("dated")))
    assert Counter((r.url, str(r.fetched), r.blocked) for r in got.collect() if r.blocked) == Counter([("http://x.BAD.com:80/a", "2024-01-10", True), ("http://ok.bad.com", "2024-01-12", True)])
    assert got.count() == 7


def test_url_filters_of_addresses(spark):
    urls = ["http://1.2.3.4/x", "http://u@1.2.3.4:80/", "http://9.2.3.4", "http://[2001:db8::1]:8080/a", "http://[2001:DB8::1]", "http://a.2.3.4x.com/", "http://[bad/x"]
    entries = spark.createDataFrame([("2.3.4", "block"), ("1.2.3.4", "block"), ("[2001:db8::1]", "block"), ("3.4x.com", "block")], "domain string, action string").withColumn("dated", F.to_date(F.lit("2024-01-01")))
    seen = spark.createDataFrame([(u,) for u in urls], "url string").withColumns({"fetched": F.to_date(F.lit("2024-02-01")), "blocked": F.lit("x")})
    got = {r.url: (r.host, r.matched_domain, r.blocked) for r in url_filters.filtered(seen, entries).collect()}
    assert got == {
        urls[0]: ("1.2.3.4", "1.2.3.4", True), urls[1]: ("1.2.3.4", "1.2.3.4", True), urls[2]: ("9.2.3.4", None, False), urls[3]: ("[2001:db8::1]", "[2001:db8::1]", True),
        urls[4]: ("[2001:db8::1]", "[2001:db8::1]", True), urls[5]: ("a.2.3.4x.com", "3.4x.com", True), urls[6]: ("[bad", None, False),
    }
    assert url_filters.filtered(seen.limit(0), entries).count() == 0
    assert [r.blocked for r in url_filters.filtered(seen, entries.limit(0)).collect()] == [False] * len(urls)


def test_empty_tables(docs, spark):
    none = docs.limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    for made in (
        substring_dedup.dedup_substrings(none), suffix_dedup.dedup_strings(none), near_dedup.near_duplicates(none), mixing.mix_sources(none),
        decontamination.contamination(none, items), identify(none, learn(none)), pitman_yor.scored(none, F.lit(False)), quality_rules.quality(none, none.select("doc_id", F.lit(1).alias("quality"))),
    ):
        assert made.count() == 0
    assert decontamination.contamination(docs, items).where("contaminated").count() == 0
