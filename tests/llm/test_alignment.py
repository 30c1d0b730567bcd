"""Token alignment against whole texts encoded one by one and overlaps compared pair by pair."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from colloquy.llm import token_alignment as T

FOLDER = "/opt/tokenizers"
A, B = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(A), reason="no tokenizer files here")
SCHEMA = "doc_id long, text string, n_a string, groups string"


def brute(rows):
    """The contract's rows, each text encoded whole by the library named with the file."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    alphabet = T.byte_alphabet()
    a_bytes = lambda i: bytes(alphabet[c] for c in a.id_to_token(i))
    b_bytes = lambda i: bytes([b.id_to_piece(i) and int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def placed(ids, of):
        at, out = 0, []
        for i in ids:
            out.append((i, at, at + len(of(i))))
            at = out[-1][2]
        return out

    found = []
    for doc_id, text in rows:
        ta, tb = [], []
        if text:
            ta, tb = placed(a.encode(" " + text, add_special_tokens=False).ids, a_bytes), placed(b.encode(text), b_bytes)
            if not b"".join(a_bytes(i) for i, *_ in ta) == (" " + text).encode() == b"".join(b_bytes(i) for i, *_ in tb):
                ta, tb = [], []
        links = [(x, y) for x, s, e in ta for y, u, v in tb if s < v and u < e]
        cuts = sorted({e for *_, e in ta} & {e for *_, e in tb})
        groups = ["|".join(",".join(str(i) for i, s, e in t if lo <= s and e <= hi) for t in (ta, tb)) for lo, hi in zip([0, *cuts], cuts)]
        found.append((doc_id, len(ta), len(tb), links, groups))
    count = Counter(p for *_, links, _ in found for p in set(links))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return sorted(
        ((d, na, nb, len(g), len(ls), sum(count[p] == best[p[0]] for p in ls), sum(count[p] for p in ls), ";".join(g)) for d, na, nb, ls, g in found), key=str
    )


def got(spark, rows, **options):
    found = T.aligned(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA), A, B, **options)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("block_bytes", [16 << 20, 64])
def test_alignment(spark, block_bytes):
    words = "the cat's 12345 über naïve 日本語 <|endoftext|> <s> </s> tokenization. x\ny  z".split(" ")
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(30)]
    rows += [(40, None), (41, ""), (42, " "), (43, "\n\n "), (44, "a ▁ b"), (45, "zero\0byte "), (None, "no id here"), (7, "the cat's"), (7, "the cat's"), (46, "  led by spaces"), (47, "é wide 😀😀")]
    assert got(spark, rows, block_bytes=block_bytes) == brute(rows)


def test_alignment_of_empty_tables_and_long_texts(spark):
    assert got(spark, []) == []
    long = " ".join(f"word{i % 977}" for i in range(300_000))
    (_, n_a, n_b, n_groups, n_links, n_best, total, groups), short = got(spark, [(1, long), (2, "word1 word2")])
    assert len(long) > 2 << 20 and n_links == n_a + n_b - n_groups and groups.count(";") == n_groups - 1
    assert short[4] == short[5] and 0 < n_best <= n_links <= total


def test_chunks_have_the_tokens_of_the_whole_text():
    tok = T.Tokenizers(A, B)
    assert tok.splits and tok.ranked
    alphabet = [*"ab '.,\n\t  é日本\x00\x1c  😀１３\xa0 ", "'s", "the", " <s>", "<|endoftext|>", "\r\n", "́"]
    rng = random.Random(11)
    for _ in range(1500):
        text = "".join(rng.choices(alphabet, k=rng.randint(1, 25)))
        chunks = T.Chunks()
        cut = [chunks.texts[i] for i in chunks.of(text)]
        a, _, b, _ = tok.encode(cut)
        assert " ".join(cut) == text
        assert a.tolist() == tok.a.encode(" " + text, add_special_tokens=False).ids and b.tolist() == tok.b.encode(text)


def test_pointers_reach_the_end_of_their_group():
    rng = np.random.default_rng(5)
    for _ in range(50):
        size = int(rng.integers(2, 60))
        a, b = (np.append(np.flatnonzero(rng.random(size - 1) < 0.5) + 1, size) for _ in "ab")
        cuts = np.intersect1d(a, b)
        want = np.searchsorted(a, cuts)[np.searchsorted(cuts, np.concatenate([a, b]))]
        assert T.terminals(a, b).tolist() == want.tolist()
