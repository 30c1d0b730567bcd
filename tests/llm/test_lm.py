"""Pitman-Yor scoring against exact distributions, a plain chain over the whole corpus, and customer-by-customer Gibbs sampling."""

import functools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from colloquy.llm import blocks as B
from colloquy.llm import pitman_yor as P
from colloquy.llm import seating as S
from pyspark.sql import functions as F

from test_brute import WORD

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@functools.lru_cache(2)
def logs_of(customers, discount):
    """Logs of the weights of each number of tables before what new tables weigh, by the recursion over customers."""
    logs, tables = np.full(customers + 2, -np.inf), np.arange(customers + 2)
    logs[1] = 0
    for seated in range(1, customers):
        joined = logs[1 : seated + 2] + np.log(np.maximum(seated - discount * tables[1 : seated + 2], 1e-300))
        logs[1 : seated + 2] = np.logaddexp(joined, logs[: seated + 1])
    return logs


def exact(customers, weight, step, discount):
    """Chances of each number of tables."""
    logs = logs_of(customers, discount).copy()
    logs[2:] += np.cumsum(np.log(weight + step * np.arange(1, customers + 1)))
    chance = np.exp(logs - logs.max())
    return chance / chance.sum()


@pytest.mark.parametrize("discount,strength", [(P.DISCOUNT, P.STRENGTH), (P.PARENT_DISCOUNT, P.PARENT_STRENGTH)])
def test_seatings_have_the_chances_of_the_restaurant(discount, strength):
    rng = np.random.default_rng(4)
    for customers in (1, 2, 3, 5, 12, 60, 1024, 1025, 3000, 10_000):
        for others, parent in ((0, 1e-6), (3, 0.2), (20, 0.01), (20, 0.9), (500, 0.05), (3000, 0.3), (50_000, 0.05), (5000, 0.9)):
            n = 20_000 if customers < 100 else 2000
            want = exact(customers, (strength + discount * others) * parent, discount * parent, discount)
            mean = (want * np.arange(len(want))).sum()
            spread = math.sqrt(max((want * np.arange(len(want)) ** 2).sum() - mean**2, 0))
            got = np.ones(n, np.int64)
            for _ in range(1 if customers <= S.TABLE else 3):  # a chain begins far off
                key = rng.integers(0, 2**63, n).astype(np.uint64)
                got = S.seated(np.full(n, customers), np.full(n, others), np.full(n, parent), discount, strength, key, got)
            assert abs(got.mean() - mean) <= 4 * spread / math.sqrt(n) + 1e-3, (customers, others, parent)
            assert abs(got.std() - spread) <= 0.1 * spread + 0.02, (customers, others, parent)


def test_a_chain_that_has_the_right_chances_keeps_them():
    customers, others, parent, n = 1500, 40, 0.4, 20_000
    want = exact(customers, (P.STRENGTH + P.DISCOUNT * others) * parent, P.DISCOUNT * parent, P.DISCOUNT)
    rng = np.random.default_rng(6)
    got = rng.choice(len(want), n, p=want)
    for _ in range(5):
        got = S.seated(np.full(n, customers), np.full(n, others), np.full(n, parent), P.DISCOUNT, P.STRENGTH, rng.integers(0, 2**63, n).astype(np.uint64), got)
    places = np.flatnonzero(want * n > 20)
    off = (np.bincount(got, minlength=len(want))[places] - n * want[places]) ** 2 / (n * want[places])
    assert off.sum() < len(places) + 4 * math.sqrt(2 * len(places))


@pytest.mark.parametrize("discount", [P.DISCOUNT, P.PARENT_DISCOUNT])
def test_stirling_numbers_without_the_recursion(discount):
    for c in (300, S.TABLE):
        t = np.arange(1.0, c)
        off = S.log_stirling(np.full(len(t), float(c)), t, discount) + math.lgamma(c) - S.stirling_table(discount)[c, 1:c]
        few = t <= S.SUMMED * c**discount
        assert np.abs(off[few]).max() < 1e-7 and np.abs(off[~few]).max() < 0.01 and np.abs(np.diff(off[~few])).max() < 1e-2
        assert np.abs(np.diff(off)[: int(0.9 * c)]).max() < 4e-3


def test_gamma():
    x = np.concatenate([np.linspace(0.01, 9, 200), np.logspace(1, 9, 50)])
    assert np.allclose(S.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=2e-9)


def test_chances_sum_to_one():
    rng = np.random.default_rng(1)
    guests, held = rng.integers(1, 50, 300), np.ones(300, np.int64)
    held = np.minimum(guests, rng.integers(1, 9, 300))
    sums = P.Sums(int(guests.sum()), int(held.sum()), 300, np.zeros(0), np.zeros(0))
    parent = sums.parent(np.append(guests, 0), np.append(held, 0))  # the last stands for all unknown words
    assert parent.sum() == pytest.approx(1, abs=1e-12)
    customers = np.append(rng.integers(0, 5, 300), 0)
    tables = np.minimum(customers, rng.integers(1, 3, 301))
    assert P.predictive(customers, tables, customers.sum(), tables.sum(), parent).sum() == pytest.approx(1, abs=1e-12)


class Chain:
    """The sampler's sweeps over a corpus in one place, with dictionaries for what the shards hold."""

    def __init__(self, texts, learned):
        self.names = {}
        rows = [[P.START, *(self.number(w) for w in WORD.findall((t or "").translate(LOW))), P.END] for t in texts]
        self.pairs = [list(zip(r, r[1:])) for r in rows]
        self.counts = Counter(p for row, known in zip(self.pairs, learned) if known for p in row)
        self.seen = Counter(w for row, known in zip(self.pairs, learned) if known for _, w in row)
        self.tables = dict.fromkeys(self.counts, 1)
        self.held = dict.fromkeys(self.seen, 1)
        self.v = len(self.seen)

    def number(self, word):
        if word not in self.names:
            raw = np.frombuffer(word.encode(), np.uint8)
            self.names[word] = B.word_hashes(raw, np.array([0]), np.array([len(raw)]))[0]
        return self.names[word]

    def sweep(self, n):
        if n:
            dishes, all_of = list(self.counts), Counter()
            for (u, _), t in self.tables.items():
                all_of[u] += t
            own = np.array([self.tables[d] for d in dishes])
            others = np.array([all_of[u] for u, _ in dishes]) - own
            keys = P.step_key(2 * n, np.array([u for u, _ in dishes], np.uint64), np.array([w for _, w in dishes], np.uint64))
            new = S.seated(np.array([self.counts[d] for d in dishes]), others, np.array([self.parent(w) for _, w in dishes]), P.DISCOUNT, P.STRENGTH, keys, own)
            self.tables = dict(zip(dishes, new.tolist()))
        self.guests = Counter()
        for (_, w), t in self.tables.items():
            self.guests[w] += t
        words = list(self.guests)
        own = np.array([self.held[w] for w in words])
        even = np.full(len(words), 1 / (self.v + 1))
        new = S.seated(np.array([self.guests[w] for w in words]), sum(self.held.values()) - own, even, P.PARENT_DISCOUNT, P.PARENT_STRENGTH, P.step_key(2 * n + 1, np.array(words, np.uint64)), own)
        self.held = dict(zip(words, new.tolist()))
        self.sums = P.Sums(sum(self.guests.values()), sum(self.held.values()), self.v, np.zeros(0), np.zeros(0))
        self.here, self.all_of = Counter(), Counter()
        for (u, _), c in self.counts.items():
            self.here[u] += c
        for (u, _), t in self.tables.items():
            self.all_of[u] += t

    def parent(self, w):
        return float(self.sums.parent(np.array([float(self.guests[w])]), np.array([float(self.held.get(w, 0))]))[0])

    def chance(self, pair):
        u, w = pair
        return float(P.predictive(self.counts[pair], self.tables.get(pair, 0), self.here[u], self.all_of[u], self.parent(w)))


@pytest.mark.parametrize("shard_tokens", [P.SHARD_TOKENS, 300])
def test_scores(docs, shard_tokens):
    rows = docs.collect()
    held = F.coalesce(F.col("doc_id") == 9, F.lit(False))
    chain = Chain([r.text for r in rows], [r.doc_id != 9 for r in rows])
    chances = defaultdict(float)
    for n in range(P.BURN_IN + P.SAMPLES + 1):
        chain.sweep(n)
        if n > P.BURN_IN:
            for pair in {p for row in chain.pairs for p in row}:
                chances[pair] += chain.chance(pair) / P.SAMPLES
    total = sum(chain.seen.values())
    want = {}
    for r, pairs in zip(rows, chain.pairs):
        base = sum(math.log10((chain.seen[w] + 0.1) / (total + 0.1 * (chain.v + 1))) for _, w in pairs)
        want[r.doc_id, r.text] = (len(pairs), sum(chain.seen[w] > 0 for _, w in pairs), total, base, sum(math.log10(chances[p]) for p in pairs))
    odd = docs.withColumns({"score": F.lit("x"), "n_known": F.lit(None), "_held": F.lit(1)}).drop("_held")
    for n in (1, 5):
        got = P.scored(odd.repartition(n), held, shard_tokens=shard_tokens).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == pytest.approx(want[r.doc_id, r.text], rel=1e-9)


def test_averages_agree_with_seating_one_customer_at_a_time():
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("aaaabbbccde") for _ in range(12)) for _ in range(12)]
    chain = Chain(texts, [True] * len(texts))
    names = {int(h): w for w, h in chain.names.items()} | {int(P.START): "^", int(P.END): "$"}
    wanted = {p for row in chain.pairs for p in row}
    ours, n = Counter(), 400
    for k in range(n + 20):
        chain.sweep(k)
        if k >= 20:
            for p in wanted:
                ours[p] += chain.chance(p) / n

    # dishes as lists of table sizes; a context's table is a customer of the parent
    d, th, d0, th0, v = P.DISCOUNT, P.STRENGTH, P.PARENT_DISCOUNT, P.PARENT_STRENGTH, chain.v
    rest, root = defaultdict(lambda: defaultdict(list)), defaultdict(list)
    guests = tables = 0
    here, held = Counter(), Counter()

    def root_chance(w):
        return (max(sum(root[w]) - d0 * len(root[w]), 0) + (th0 + d0 * tables) / (v + 1)) / (th0 + guests)

    def sit(sizes, discount, new):
        at = rnd.random() * (new + sum(sizes) - discount * len(sizes))
        for i, s in enumerate(sizes):
            at -= s - discount
            if at < 0:
                sizes[i] += 1
                return False
        sizes.append(1)
        return True

    def leave(sizes):
        at = rnd.randrange(sum(sizes))
        for i, s in enumerate(sizes):
            at -= s
            if at < 0:
                break
        sizes[i] -= 1
        if not sizes[i]:
            del sizes[i]
            return True
        return False

    def enter(u, w):
        nonlocal guests, tables
        if sit(rest[u][w], d, (th + d * held[u]) * root_chance(w)):
            held[u] += 1
            tables += sit(root[w], d0, (th0 + d0 * tables) / (v + 1))
            guests += 1
        here[u] += 1

    def exit_(u, w):
        nonlocal guests, tables
        if leave(rest[u][w]):
            held[u] -= 1
            tables -= leave(root[w])
            guests -= 1
        here[u] -= 1

    customers = [p for row in chain.pairs for p in row]
    for p in customers:
        enter(*p)
    theirs, m = Counter(), 500
    for k in range(m + 30):
        for p in customers:
            exit_(*p)
            enter(*p)
        if k >= 30:
            for u, w in wanted:
                own = rest[u][w]
                theirs[u, w] += (max(sum(own) - d * len(own), 0) + (th + d * held[u]) * root_chance(w)) / (th + here[u]) / m
    off = {(names[int(u)], names[int(w)]): abs(ours[u, w] / theirs[u, w] - 1) for u, w in wanted}
    assert max(off.values()) < 0.12 and sum(off.values()) / len(off) < 0.04, max(off.items(), key=lambda x: x[1])
