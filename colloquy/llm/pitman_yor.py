"""LM scoring with a hierarchical Pitman-Yor model of word pairs.

Every word is a context with a restaurant of its own: what follows the word are customers, and
each table there is a customer of the restaurant that all contexts share as their parent. The
parent falls back on an even choice among the vocabulary. The seatings of all restaurants are
sampled together by Gibbs sweeps: contexts are seated given the parent's chances of the last
sweep, then the parent given the tables that contexts have now. Predictive probabilities, of
both levels at once, are averaged over the last sweeps.

The pairs of a context are held by one shard, or by as many slices as its share of the corpus
asks for; so are the words, by the parent's shards. Blocks of texts send them their counts once;
then, sweep by sweep, the context shards send what each word has for tables, and get back how
the word sits with the parent. Everything sent is a whole number, sums are exact, and chance
comes from hashes of the words, so the scores don't depend on how the texts are split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm import blocks as B
from colloquy.llm.blobs import opened, runs, slim, squeezed, table_of
from colloquy.llm.repeats import as_rows, block_ids
from colloquy.llm.seating import seated
from colloquy.llm.shared import Scratch, stored

#: Discount and strength of the context restaurants and of their parent.
DISCOUNT, STRENGTH = 0.75, 2.0
PARENT_DISCOUNT, PARENT_STRENGTH = 0.6, 10.0
#: Sweeps that are left out of the average, and sweeps in it.
BURN_IN, SAMPLES = 1, 3
#: Bytes of text in a block, and tokens of the corpus for each shard.
BLOCK_BYTES = 4 << 20
SHARD_TOKENS = 2_000_000
#: Most contexts that are dealt in slices; all tasks know them (16 bytes each).
MOST_SLICED = 1 << 20

START, END = B.U64(0xA0761D6478BD642F), B.U64(0xE7037ED1A0B428DB)
_CONTEXT, _WORD, _SLICE = (B.U64(x) for x in (0x8BB84B93962EACC9, 0x2D358DCCAA6C78A5, 0x4B33A62ED433D4A3))

#: Rows between shards: where to, what, where from, numbers, and arrays.
MESSAGE = pa.schema([("part", pa.int32()), ("kind", pa.int8()), ("other", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("blob", pa.binary())])
_MESSAGE = "part int, kind byte, other long, a long, b long, blob binary"
STATIC, STATE, ASKED, SENT, SLICED = range(5)
REPLY = pa.schema([("block", pa.int64()), ("kind", pa.int8()), ("part", pa.int32()), ("blob", pa.binary())])


def _numbered(text_col: str):
    """Blocks of texts: ids, which are held out, words of each, distinct words, and the words as numbers of these; each text closes with the end word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = block_ids()
        for batch in B.as_batch(batches, text_col, BLOCK_BYTES):
            data, offsets = B.text_of(batch.column(text_col))
            data = B.LOWER[data]
            starts, ends, first = B.words_of(data, offsets)
            n = len(first) - 1
            words = np.empty(len(starts) + n, B.U64)
            closing = first[1:] + np.arange(n)
            inner = np.ones(len(words), bool)
            inner[closing] = False
            words[inner], words[closing] = B.word_hashes(data, starts, ends), END
            vocabulary, token = np.unique(words, return_inverse=True)
            held = batch.column("_held").to_numpy(zero_copy_only=False).astype(np.uint8)
            rows = {k: batch.column(f"_{k}").to_numpy() for k in ("row1", "row2")}
            blob = squeezed(**rows, held=held, sizes=slim(np.diff(first) + 1), words=np.diff(vocabulary, prepend=B.U64(0)), tokens=slim(token))
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((next(numbers), pa.int64()), (len(words), pa.int64()), (n, pa.int64()), (blob, pa.binary()))], names=["block", "tokens", "texts", "blob"])

    return run


def read_block(blob: bytes) -> dict[str, np.ndarray]:
    block = opened(blob)
    return block | {"words": np.cumsum(block["words"], dtype=B.U64)}


class Deal:
    """Which shard holds a pair or a word; `sliced` contexts are dealt over `slices` shards, by what follows."""

    def __init__(self, shards: int, sliced: np.ndarray, slices: np.ndarray):
        self.shards, self.sliced, self.slices = shards, sliced, slices

    def index(self, contexts: np.ndarray) -> np.ndarray:
        """The place of each context among the sliced ones, -1 for others."""
        if not len(self.sliced):
            return np.full(len(contexts), -1, np.int64)
        at = np.minimum(np.searchsorted(self.sliced, contexts), len(self.sliced) - 1)
        return np.where(self.sliced[at] == contexts, at, -1)

    def of_pairs(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        at = self.index(contexts)
        nth = np.where(at < 0, B.U64(0), B.mix(words ^ _SLICE) % (self.slices[at] if len(self.slices) else B.U64(1)))
        return (B.mix((contexts ^ _CONTEXT) + nth) % B.U64(self.shards)).astype(np.int64)

    def of_words(self, words: np.ndarray) -> np.ndarray:
        return (B.mix(words ^ _WORD) % B.U64(self.shards)).astype(np.int64)


class Pairs:
    """Distinct pairs of a block in the order in which shards are asked about them, and each token's pair."""

    def __init__(self, block: dict[str, np.ndarray], deal: Deal):
        words, token = np.append(block["words"], START), block["tokens"].astype(np.int64)
        sizes = block["sizes"].astype(np.int64)
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[np.cumsum(sizes) - sizes] = len(words) - 1
        train = np.repeat(block["held"] == 0, sizes)
        pairs, of_token = np.unique(before * len(words) + token, return_inverse=True)
        part = deal.of_pairs(words[pairs // len(words)], words[pairs % len(words)])
        order = np.argsort(part, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.of_token, self.part = back[of_token], part[order]
        self.context, self.word = pairs[order] // len(words), pairs[order] % len(words)
        self.count = np.bincount(self.of_token, train, len(pairs)).astype(np.int64)
        # a context is named once in each shard that has some of its pairs
        self.heads = np.flatnonzero(np.append(True, (self.context[1:] != self.context[:-1]) | (self.part[1:] != self.part[:-1])))
        self.words, self.token, self.sizes = words, token, sizes


def word_order(words: np.ndarray, deal: Deal) -> tuple[np.ndarray, np.ndarray]:
    """The order in which shards are asked about words, and their shards in that order."""
    part = deal.of_words(words)
    order = np.argsort(part, kind="stable")
    return order, part[order]


def _ask(make):
    """For each block the rows that `make` sends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column("block").to_pylist(), batch.column("blob").to_pylist()):
                yield from as_rows(list(make(number, read_block(blob))), ["part", "block", "blob"], [pa.int32(), pa.int64(), pa.binary()])

    return run


def _words_asked(deal: Deal):
    def make(number: int, block: dict[str, np.ndarray]):
        order, part = word_order(block["words"], deal)
        token, train = block["tokens"].astype(np.int64), np.repeat(block["held"] == 0, block["sizes"].astype(np.int64))
        counts, learned = np.bincount(token, minlength=len(order))[order], np.bincount(token, train, len(order)).astype(np.int64)[order]
        for p, a, b in runs(part):
            yield p, number, squeezed(words=block["words"][order[a:b]], counts=slim(counts[a:b]), learned=slim(learned[a:b]))

    return _ask(make)


def _pairs_asked(deal: Deal):
    def make(number: int, block: dict[str, np.ndarray]):
        pairs = Pairs(block, deal)
        own = np.append(pairs.heads, len(pairs.part))
        for p, a, b in runs(pairs.part):
            c, d = np.searchsorted(pairs.heads, (a, b))
            heads = pairs.heads[c:d]
            yield p, number, squeezed(contexts=np.diff(pairs.words[pairs.context[heads]], prepend=B.U64(0)), sizes=slim(np.diff(own[c : d + 1])), words=pairs.words[pairs.word[a:b]], counts=slim(pairs.count[a:b]))

    return _ask(make)


def _asks(group: pa.Table) -> tuple[int, list[int], list[dict[str, np.ndarray]]]:
    """The shard, and its blocks and what each asks, in the blocks' order."""
    asks = sorted(zip(group.column("block").to_pylist(), group.column("blob").to_pylist()))
    return group.column("part")[0].as_py(), [b for b, _ in asks], [opened(x) for _, x in asks]


def _together(asks: list[dict[str, np.ndarray]], name: str) -> np.ndarray:
    return np.concatenate([a[name] for a in asks])


def _asked_row(part: int, blocks: list[int], of: np.ndarray, sizes: list[int], **more: np.ndarray) -> tuple:
    """What each block asked about, as numbers of what the shard holds; they rise within a block mostly, so their steps are small."""
    step = np.diff(of, prepend=0)
    return part, ASKED, 0, 0, 0, squeezed(blocks=np.array(blocks, np.int64), sizes=np.array(sizes, np.int64), low=(step & 0xFFFF).astype(np.uint16), high=(step >> 16).astype(np.int32), **more)


def _asked(row: dict[str, np.ndarray]) -> np.ndarray:
    return np.cumsum(row["low"].astype(np.int64) + (row["high"].astype(np.int64) << 16))


def _word_shard(least: int):
    """The words of a shard with their counts; and words that stand at least `least` times, as contexts to slice."""

    def run(group: pa.Table) -> pa.Table:
        part, blocks, asks = _asks(group)
        words, of = np.unique(_together(asks, "words"), return_inverse=True)
        counts, learned = (np.bincount(of, _together(asks, k), len(words)).astype(np.int64) for k in ("counts", "learned"))
        rows = [(part, STATIC, 0, int(learned.sum()), int((learned > 0).sum()), squeezed(words=words, learned=slim(learned)))]
        rows.append(_asked_row(part, blocks, of, [len(a["words"]) for a in asks]))
        rows += [(part, SLICED, int(words[i].astype(np.int64)), int(counts[i]), 0, b"") for i in np.flatnonzero(counts >= least)]
        return table_of(rows, MESSAGE)

    return run


def _to_words(part: int, words: np.ndarray, order: np.ndarray, of: np.ndarray, **arrays: np.ndarray) -> list[tuple]:
    """Messages to the shards of `words`, in their order."""
    return [(p, SENT, part, 0, 0, squeezed(words=words[order[a:b]], **{k: slim(x[order[a:b]]) for k, x in arrays.items()})) for p, a, b in runs(of)]


def _sliced_rows(part: int, deal: Deal, contexts: np.ndarray, customers: np.ndarray, tables: np.ndarray) -> list[tuple]:
    at = np.flatnonzero(deal.index(contexts) >= 0)
    return [(part, SLICED, int(contexts[i].astype(np.int64)), int(customers[i]), int(tables[i]), b"") for i in at]


def _context_shard(deal: Deal):
    """The dishes of a shard's contexts, each customer of which begins at a table that all of a dish share."""

    def run(group: pa.Table) -> pa.Table:
        part, blocks, asks = _asks(group)
        sizes = [a["sizes"].astype(np.int64) for a in asks]
        contexts, context_of = np.unique(np.concatenate([np.cumsum(a["contexts"], dtype=B.U64) for a in asks]), return_inverse=True)
        of_pair, words = np.repeat(context_of, np.concatenate(sizes)), _together(asks, "words")
        order = np.lexsort((words, of_pair))
        new = np.append(True, (of_pair[order][1:] != of_pair[order][:-1]) | (words[order][1:] != words[order][:-1]))
        dish = np.empty(len(order), np.int64)
        dish[order] = np.cumsum(new) - 1
        context, words = of_pair[order][new], words[order][new]
        customers = np.bincount(dish, _together(asks, "counts"), len(words)).astype(np.int64)
        # only where a dish has two customers or more is there something to sample
        busy = np.flatnonzero(customers > 1)
        met, word_of = np.unique(words[busy], return_inverse=True)
        by_part, _ = word_order(met, deal)
        rank = np.empty(len(met), np.int64)
        rank[by_part] = np.arange(len(met))
        met, word_of = met[by_part], rank[word_of]
        alone = np.bincount(context, customers == 1, len(contexts)).astype(np.int64)
        here = np.bincount(context, customers, len(contexts)).astype(np.int64)
        rows = [(part, STATIC, 0, 0, 0, squeezed(contexts=contexts, dishes=slim(np.bincount(context, minlength=len(contexts))), customers=slim(customers), words=met, word_of=slim(word_of)))]
        rows.append((part, STATE, 0, 0, 0, squeezed(tables=np.ones(len(busy), np.uint8), summed=np.zeros(len(busy), np.uint8))))
        heads = np.cumsum([0] + [len(x) for x in sizes])
        more = {"sizes_of": slim(np.concatenate(sizes)), "context_of": slim(context_of), "heads": heads}
        rows.append(_asked_row(part, blocks, dish, [len(a["words"]) for a in asks], **more))
        some = np.flatnonzero(customers > 0)
        known, of = np.unique(words[some], return_inverse=True)
        single, tables = (np.bincount(of, x, len(known)).astype(np.int64) for x in (customers[some] == 1, customers[some] > 1))
        rows += _to_words(part, known, *word_order(known, deal), single=single, tables=tables)
        rows += _sliced_rows(part, deal, contexts, here, alone + np.bincount(context[busy], minlength=len(contexts)))
        return table_of(rows, MESSAGE)

    return run


def _rows_of(group: pa.Table, kind: int) -> list[dict[str, np.ndarray]]:
    """The arrays of the rows of one kind, by where they come from."""
    rows = sorted((o, b) for k, o, b in zip(group.column("kind").to_pylist(), group.column("other").to_pylist(), group.column("blob").to_pylist()) if k == kind)
    return [opened(b) for _, b in rows]


def step_key(step: int, *words: np.ndarray) -> np.ndarray:
    """Where the chance of a dish comes from in a step of the sampler: the step and the words that name the dish."""
    key = B.U64(0x4D5A2DA51DE1AA47 * step % 2**64)
    for w in words:
        key = B.mix(w + key)
    return key


class Sums:
    """What all tasks know of a sweep: the parent's customers and tables, the vocabulary, and the sliced contexts' customers and tables."""

    def __init__(self, customers: int, tables: int, vocabulary: int, sliced_customers: np.ndarray, sliced_tables: np.ndarray):
        self.customers, self.tables, self.vocabulary = customers, tables, vocabulary
        self.sliced_customers, self.sliced_tables = sliced_customers, sliced_tables

    def parent(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The parent's chance of words, each with its customers and tables there; a word without customers has the share of all unknown ones."""
        here = PARENT_STRENGTH + self.customers
        even = (PARENT_STRENGTH + PARENT_DISCOUNT * self.tables) / here / (self.vocabulary + 1)
        return np.maximum(customers - PARENT_DISCOUNT * tables, 0) / here + even


def predictive(customers: np.ndarray, tables: np.ndarray, here: np.ndarray, held: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """The chance of dishes, given their customers and tables, their restaurants' (`here`, `held`), and the parent's chances."""
    return (np.maximum(customers - DISCOUNT * tables, 0) + (STRENGTH + DISCOUNT * held) * parent) / (STRENGTH + here)


class Restaurants:
    """A context shard between sweeps."""

    def __init__(self, static: dict[str, np.ndarray], deal: Deal):
        self.contexts, self.customers = static["contexts"], static["customers"].astype(np.int64)
        self.context = np.repeat(np.arange(len(self.contexts)), static["dishes"].astype(np.int64))
        self.busy = np.flatnonzero(self.customers > 1)
        self.words, self.word_of = static["words"], static["word_of"].astype(np.int64)
        self.alone = np.bincount(self.context, self.customers == 1, len(self.contexts)).astype(np.int64)
        self.here = np.bincount(self.context, self.customers, len(self.contexts)).astype(np.int64)
        self.sliced = deal.index(self.contexts)

    def tables_of(self, tables: np.ndarray) -> np.ndarray:
        """Tables of each context in this shard."""
        return self.alone + np.bincount(self.context[self.busy], tables, len(self.contexts)).astype(np.int64)

    def whole(self, own: np.ndarray, sliced: np.ndarray) -> np.ndarray:
        """`own` sums of each context, and for a sliced one those over all its slices."""
        return np.where(self.sliced >= 0, sliced[self.sliced], own) if len(sliced) else own

    def swept(self, tables: np.ndarray, parent: np.ndarray, sums: Sums, sweep: int) -> np.ndarray:
        """Tables of the busy dishes after a sweep, given the parent's chance of each of the shard's words."""
        at = self.context[self.busy]
        others = self.whole(self.tables_of(tables), sums.sliced_tables)[at] - tables
        key = step_key(2 * sweep, self.contexts[at], self.words[self.word_of])
        return seated(self.customers[self.busy], others, parent[self.word_of], DISCOUNT, STRENGTH, key, tables)


def _sweep_contexts(deal: Deal, sums: Sums, sweep: int):
    def run(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        (static,), (state,) = _rows_of(group, STATIC), _rows_of(group, STATE)
        replies = _rows_of(group, SENT)
        shard = Restaurants(static, deal)
        customers, held = ([np.zeros(0)], [np.zeros(0)]) if not replies else ([r[k] for r in replies] for k in ("customers", "tables"))
        parent = sums.parent(np.concatenate(customers).astype(np.float64), np.concatenate(held).astype(np.float64))
        tables = shard.swept(state["tables"].astype(np.int64), parent, sums, sweep)
        held = shard.tables_of(tables)
        kept = {k: x for k, x in state.items() if k.startswith("held")}
        if sweep > BURN_IN:
            kept[f"held{sweep}"] = slim(held)
        summed = state["summed"].astype(np.int64) + (tables if sweep > BURN_IN else 0)
        rows = [(part, STATE, 0, 0, 0, squeezed(tables=slim(tables), summed=slim(summed), **kept))]
        rows += _to_words(part, shard.words, *word_order(shard.words, deal), tables=np.bincount(shard.word_of, tables, len(shard.words)).astype(np.int64))
        rows += _sliced_rows(part, deal, shard.contexts, shard.here, held)
        return table_of(rows, MESSAGE)

    return run


def _sweep_words(sums: Sums, sweep: int):
    """The parent's seating of a shard's words, given the tables that contexts have; context shards hear of the words that they sample."""

    def run(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        (static,) = _rows_of(group, STATIC)
        words = static["words"]
        sent = sorted((o, b) for k, o, b in zip(group.column("kind").to_pylist(), group.column("other").to_pylist(), group.column("blob").to_pylist()) if k == SENT)
        messages = [(o, opened(b)) for o, b in sent]
        state = _rows_of(group, STATE)
        single = state[0]["single"].astype(np.int64) if state else np.zeros(len(words), np.int64)
        tables = state[0]["tables"].astype(np.int64) if state else None
        places = [np.searchsorted(words, m["words"]) for _, m in messages]
        more = np.zeros(len(words), np.int64)
        for (_, m), at in zip(messages, places):
            more[at] += m["tables"].astype(np.int64)
            if not state:
                single[at] += m["single"].astype(np.int64)
        customers = single + more
        tables = (customers > 0).astype(np.int64) if tables is None else tables
        even = np.full(len(words), 1.0 / (sums.vocabulary + 1))
        key = step_key(2 * sweep + 1, words)
        tables = seated(customers, sums.tables - tables, even, PARENT_DISCOUNT, PARENT_STRENGTH, key, tables)
        kept = {k: x for k, x in (state[0].items() if state else ()) if k.startswith(("guests", "held"))}
        if sweep > BURN_IN:
            kept |= {f"guests{sweep}": slim(customers), f"held{sweep}": slim(tables)}
        rows = [(part, STATE, 0, int(customers.sum()), int(tables.sum()), squeezed(single=slim(single), tables=slim(tables), **kept))]
        for (origin, m), at in zip(messages, places):
            at = at[m["tables"] > 0]
            if len(at):
                rows.append((origin, SENT, part, 0, 0, squeezed(customers=slim(customers[at]), tables=slim(tables[at]))))
        return table_of(rows, MESSAGE)

    return run


def _samples(arrays: dict[str, np.ndarray], name: str) -> list[np.ndarray]:
    return [arrays[f"{name}{s}"].astype(np.int64) for s in range(BURN_IN + 1, BURN_IN + SAMPLES + 1)]


def _context_replies(deal: Deal, samples: list[Sums]):
    """To each block: customers and summed tables of the pairs, and customers and tables of the contexts, that it asked about."""

    def run(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        (static,), (state,), (asked,) = (_rows_of(group, k) for k in (STATIC, STATE, ASKED))
        shard = Restaurants(static, deal)
        summed = (shard.customers == 1) * SAMPLES
        summed[shard.busy] = state["summed"]
        here = shard.whole(shard.here, samples[-1].sliced_customers)
        held = [shard.whole(x, s.sliced_tables) for x, s in zip(_samples(state, "held"), samples)]
        dish, context = _asked(asked), asked["context_of"].astype(np.int64)
        ends, heads, rows = np.append(0, np.cumsum(asked["sizes"])), asked["heads"], []
        for i, block in enumerate(asked["blocks"].tolist()):
            own, of = dish[ends[i] : ends[i + 1]], context[heads[i] : heads[i + 1]]
            rows.append((block, 0, part, squeezed(customers=slim(shard.customers[own]), summed=slim(summed[own]), here=slim(here[of]), **{f"held{s}": slim(x[of]) for s, x in enumerate(held)})))
        return table_of(rows, REPLY)

    return run


def _word_replies(group: pa.Table) -> pa.Table:
    """To each block: training count, and customers and tables at the parent, of its words."""
    part = group.column("part")[0].as_py()
    (static,), (state,), (asked,) = (_rows_of(group, k) for k in (STATIC, STATE, ASKED))
    guests, held = _samples(state, "guests"), _samples(state, "held")
    of, ends, rows = _asked(asked), np.append(0, np.cumsum(asked["sizes"])), []
    for i, block in enumerate(asked["blocks"].tolist()):
        own = of[ends[i] : ends[i + 1]]
        arrays = {"learned": slim(static["learned"][own])} | {f"guests{s}": slim(x[own]) for s, x in enumerate(guests)} | {f"held{s}": slim(x[own]) for s, x in enumerate(held)}
        rows.append((block, 1, part, squeezed(**arrays)))
    return table_of(rows, REPLY)


def _scores(deal: Deal, n: int, v: int, samples: list[Sums]):
    """Per text of a block: its tokens, known tokens, base score and score."""

    def run(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        found = sorted(zip(replies.column("kind").to_pylist(), replies.column("part").to_pylist(), replies.column("blob").to_pylist()))
        block = read_block(blocks.column("blob")[0].as_py())
        of_pairs, of_words = ([opened(b) for k, _, b in found if k == kind] for kind in (0, 1))
        pairs = Pairs(block, deal)
        order, _ = word_order(pairs.words[:-1], deal)

        def word(name: str) -> np.ndarray:
            out = np.empty(len(order))
            out[order] = _together(of_words, name)
            return out

        learned, customers, summed, here = word("learned"), *(_together(of_pairs, k).astype(np.float64) for k in ("customers", "summed", "here"))
        base = np.log10((learned + 0.1) / (n + 0.1 * (v + 1)))
        restaurant = np.repeat(np.arange(len(pairs.heads)), np.diff(np.append(pairs.heads, len(pairs.part))))
        chance = np.zeros(len(customers))
        for s, sums in enumerate(samples):
            parent = sums.parent(word(f"guests{s}"), word(f"held{s}"))[pairs.word]
            held = _together(of_pairs, f"held{s}").astype(np.float64)
            chance += predictive(customers, summed / SAMPLES, here[restaurant], held[restaurant], parent)
        score = np.log10(chance / SAMPLES)
        starts = np.append(0, np.cumsum(pairs.sizes))[:-1]
        add = lambda x, kind: np.add.reduceat(x.astype(kind), starts) if len(starts) else np.zeros(0, kind)
        return pa.table({
            "_row1": block["row1"], "_row2": block["row2"], "n_tokens": pairs.sizes, "n_known": add((learned > 0)[pairs.token], np.int64),
            "base_score": add(base[pairs.token], np.float64), "score": add(score[pairs.of_token], np.float64),
        })

    return run


def _grouped(df: DataFrame, shards: int, run, schema: str) -> DataFrame:
    """`run` over the rows of each shard, about as many tasks as shards."""
    return df.repartition(max(1, shards), "part").groupBy("part").applyInArrow(run, schema)


def _sliced_sums(rows: DataFrame, sliced: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Customers and tables of the sliced contexts over all slices; there are MOST_SLICED of them at most."""
    out = np.zeros((2, len(sliced)), np.int64)
    if len(sliced):
        for r in rows.where(F.col("kind") == SLICED).groupBy("other").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect():
            out[:, np.searchsorted(sliced, np.array([r["other"]], np.int64).view(B.U64)[0])] = r["a"], r["b"]
    return out[0], out[1]


def _dealt(words: DataFrame, tokens: int, texts: int, shards: int, least: int) -> Deal:
    """Contexts with more than a shard's share of the tokens are dealt in as many slices as they have shares."""
    rows = words.where(F.col("kind") == SLICED).select("other", "a").collect() + ([(int(START.astype(np.int64)), texts)] if texts >= least else [])
    contexts, counts = np.array([r[0] for r in rows], np.int64).view(B.U64), np.array([r[1] for r in rows], np.int64)
    order = np.argsort(contexts)
    return Deal(shards, contexts[order], np.maximum(1, -(-counts[order] * shards // max(tokens, 1))).astype(B.U64))


def scored(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """`docs` with held_out, n_tokens, n_known, train_tokens, base_score and score.

    A-Z are lower-cased; tokens are the words `[^\\x20\\x09-\\x0D]+` and one end. The model learns
    from all rows where `held_out` is false. base_score is the sum over tokens of
    log10((c + 0.1) / (N + 0.1 (V + 1))), with c the token's count, N all and V distinct tokens
    learned; score is the model's log10 probability of the text, so that 10 ** (-score /
    n_tokens) is its perplexity. Words are told apart by 64-bit hashes, texts by 128 bits.

    All dishes of a level take their Gibbs step side by side, each given the others as of the
    sweep before (see `seating`). Reruns agree, also over other partitions of the same rows.

    Null text: empty, so one end is scored. Without rows to learn from, N is 0 and each token
    has an even chance. Rows alike in id and text are learned from each, and have one score.
    Text of any length is taken whole. Columns of `docs` with a result's name are replaced;
    names that begin with `_` are reserved. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    results = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    row1 = F.xxhash64(F.col(id_col), F.col(text_col))
    keyed = docs.withColumns({"_held": held_out, "_row1": row1, "_row2": F.xxhash64(F.col(text_col), F.lit("row"), F.col(id_col))})
    scratch = Scratch(spark, "lm")
    try:
        found, learned = _found(scratch, keyed.select("_row1", "_row2", "_held", text_col), text_col, shard_tokens)
    finally:
        scratch.drop()
    slim_docs = keyed.select(*(c for c in docs.columns if c not in results), F.col("_held").alias("held_out"), "_row1", "_row2")
    return slim_docs.join(found, ["_row1", "_row2"]).withColumn("train_tokens", F.lit(learned).cast(T.LongType())).drop("_row1", "_row2")


def _found(scratch: Scratch, source: DataFrame, text_col: str, shard_tokens: int) -> tuple[DataFrame, int]:
    """Stored results by row, and the tokens learned."""
    blocks = scratch.buckets(source.mapInArrow(_numbered(text_col), "block long, tokens long, texts long, blob binary"), "block")
    tokens, texts = (x or 0 for x in blocks.agg(F.sum("tokens"), F.sum("texts")).first())
    shards = -(-tokens // shard_tokens) or 1
    least = max(1, tokens // min(shards, MOST_SLICED)) + 1
    asks = "part int, block long, blob binary"
    deal = Deal(shards, np.zeros(0, B.U64), np.zeros(0, B.U64))
    words = scratch.store(_grouped(blocks.mapInArrow(_words_asked(deal), asks), shards, _word_shard(least), _MESSAGE), "words")
    n, v = (x or 0 for x in words.where(F.col("kind") == STATIC).agg(F.sum("a"), F.sum("b")).first())
    deal = _dealt(words, tokens, texts, shards, least)
    contexts = scratch.store(_grouped(blocks.mapInArrow(_pairs_asked(deal), asks), shards, _context_shard(deal), _MESSAGE), "contexts")
    only = lambda df, *kinds: df.where(F.col("kind").isin(*kinds))
    fixed = {k: only(df, STATIC) for k, df in (("words", words), ("contexts", contexts))}
    now, before, samples = contexts, None, []
    sums = Sums(0, v, v, *_sliced_sums(contexts, deal.sliced))  # every word of the vocabulary begins with one table
    for sweep in range(BURN_IN + SAMPLES + 1):
        if sweep:
            sent = only(fixed["contexts"], STATIC).unionByName(only(now, STATE)).unionByName(only(before, SENT))
            now = scratch.store(_grouped(sent, shards, _sweep_contexts(deal, sums, sweep), _MESSAGE), f"contexts-{sweep}")
            sums = Sums(sums.customers, sums.tables, v, *_sliced_sums(now, deal.sliced))
            if sweep > 1:
                scratch.drop(f"contexts-{sweep - 1}")
        sent = only(fixed["words"], STATIC).unionByName(only(now, SENT))
        sent = sent.unionByName(only(before, STATE)) if before is not None else sent
        before = scratch.store(_grouped(sent, shards, _sweep_words(sums, sweep), _MESSAGE), f"words-{sweep}")
        customers, tables = (x or 0 for x in only(before, STATE).agg(F.sum("a"), F.sum("b")).first())
        sums = Sums(customers, tables, v, sums.sliced_customers, sums.sliced_tables)
        if sweep:
            scratch.drop(f"words-{sweep - 1}")
        if sweep > BURN_IN:
            samples.append(sums)
    replies = "block long, kind byte, part int, blob binary"
    of_pairs = _grouped(only(contexts, STATIC, ASKED).unionByName(only(now, STATE)), shards, _context_replies(deal, samples), replies)
    of_words = _grouped(only(words, STATIC, ASKED).unionByName(only(before, STATE)), shards, _word_replies, replies)
    schema = "_row1 long, _row2 long, n_tokens long, n_known long, base_score double, score double"
    all_of = blocks.groupBy("block").cogroup(of_pairs.unionByName(of_words).groupBy("block")).applyInArrow(_scores(deal, n, v, samples), schema)
    return stored(all_of.dropDuplicates(["_row1", "_row2"]), "lm-scores"), n
