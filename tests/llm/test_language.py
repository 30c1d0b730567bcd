"""Language ID against a parse that searches the learned text at every place."""

import random

import numpy as np
import pytest
from colloquy.llm import language_id as L
from colloquy.llm.language_id import Model, folded, identify, learn


def phrases(sample: bytes, text: bytes) -> int:
    at = n = 0
    while at < len(text):
        size = 0
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at, n = at + size + 1, n + 1
    return n


def predicted(model: Model, text: str | None) -> str:
    if text is None or not any(c.isalpha() for c in text):
        return "und"
    import pyarrow as pa

    raw = folded(pa.array([text]))[0].as_py().encode()
    costs = [(phrases(model.texts[lang], raw) + 1) * np.log(n) for lang, n in zip(model.langs, model.learned)]
    return model.langs[int(np.argmin(costs))]


@pytest.mark.parametrize("stretch", [1, 2, 7, 512])
def test_phrases_of_whole_texts(monkeypatch, stretch):
    monkeypatch.setattr(L, "STRETCH", stretch)
    rnd = random.Random(stretch)
    for letters in ("ab", "abc", "abcdefgh"):
        texts = {lang: "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 300))).encode() for lang in "xyz"}
        model = Model(texts)
        docs = ["".join(rnd.choice(letters + rnd.choice(["", "é"])) for _ in range(n)).encode() for n in (0, 1, 5, 60, 1500)]
        got = model.phrases(np.frombuffer(b"".join(docs), np.uint8), np.cumsum([0] + [len(d) for d in docs]))
        assert got.tolist() == [[phrases(texts[lang], d) for lang in model.langs] for d in docs]


def test_many_languages_and_a_bounded_model(spark):
    rnd = random.Random(3)
    words = {f"l{k:03d}": ["".join(rnd.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(12)] for k in range(90)}
    rows = [(i, " ".join(rnd.choice(words[lang]) for _ in range(60)), lang) for lang in words for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = learn(df, model_bytes=2 << 20)
    assert len(model.langs) == 90 and sum(a.nbytes for a in model.automata) <= 2 << 20
    got = identify(df, model).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(rows)


def test_ties_nulls_long_texts_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "ab ab", "bb", 0.5), (2, "ab ab", "aa", 0.5), (3, "ab ab", None, 0.5)], "doc_id long, text string, lang string, score double")
    model = learn(df)
    assert {r.lang_pred for r in identify(df, model).collect()} == {"aa"}  # alike in both: the first by name
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ..."), (4, "zz " * 900_000), (5, "ab"), (5, "ab")], "doc_id long, text string")
    got = identify(odd, model)
    assert got.columns == ["doc_id", "text", "lang_pred", "score"]
    assert sorted((r.doc_id, r.lang_pred) for r in got.select("doc_id", "lang_pred").collect()) == [(1, "und"), (2, "und"), (3, "und"), (4, "aa"), (5, "aa"), (5, "aa")]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("*", "crc32(cast(doc_id as string)) % 3 = 1 as held_out")
    model = learn(docs.where("not held_out"))
    got = identify(docs.where("held_out"), model).select("lang", "lang_pred", "text").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.99 * len(got)
    assert all(r.lang_pred == predicted(model, r.text) for r in random.Random(1).sample([r for r in got if len(r.text or "") < 3000], 25))
