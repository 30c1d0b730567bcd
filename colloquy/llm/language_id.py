"""Language ID by cross-parsing entropy over suffix automata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm import blocks as B

#: Bounds of the labelled sample: documents that are fetched and bytes that are learned, of each language.
SAMPLE_DOCS = 200
SAMPLE_BYTES = 60_000
#: Bytes of the model that is broadcast; with many languages each learns from less text, so that it holds.
MODEL_BYTES = 64 << 20
#: Bytes that are parsed side by side as if a phrase began there, until the phrases before have caught up.
STRETCH = 512

UNKNOWN = "und"
LETTER = r"\p{L}"


def folded(column: pa.Array) -> pa.Array:
    """Lower case, and each run of anything that ASCII has besides letters as one blank."""
    text = pc.utf8_lower(pc.fill_null(column.cast(pa.string()), ""))
    return pc.replace_substring_regex(text, r"[\x00-\x60\x7B-\x7F]+", " ")


class Automaton:
    """Suffix automaton of a text over byte classes, as tables of transitions.

    A walk from state 0 reads exactly the substrings of the text, so the longest match at a
    place is how far the walk gets. Most states have one way on, which is kept as (symbol,
    state); the others have a row each in a dense table, whose row 0 leads nowhere.
    """

    def __init__(self, text: bytes, classes: np.ndarray, width: int):
        nexts: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for symbol in classes[np.frombuffer(text, np.uint8)].tolist():
            new = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at != -1 and symbol not in nexts[at]:
                nexts[at][symbol] = new
                at = link[at]
            if at != -1:
                target = nexts[at][symbol]
                if length[target] == length[at] + 1:
                    link[new] = target
                else:
                    copy = len(nexts)
                    nexts.append(dict(nexts[target]))
                    length.append(length[at] + 1)
                    link.append(link[target])
                    while at != -1 and nexts[at].get(symbol) == target:
                        nexts[at][symbol] = copy
                        at = link[at]
                    link[target] = link[new] = copy
            last = new
        self.width = width
        self.only = np.zeros(len(nexts), np.uint16)  # 0 is no symbol of a text
        self.to, self.row = np.full(len(nexts), -1, np.int32), np.zeros(len(nexts), np.int32)
        many = [s for s, out in enumerate(nexts) if len(out) > 1]
        dense = np.full((len(many) + 1, width), -1, np.int32)
        for k, state in enumerate(many, 1):
            dense[k, list(nexts[state].keys())] = list(nexts[state].values())
        self.row[many] = np.arange(1, len(many) + 1)
        for state, out in enumerate(nexts):
            if len(out) == 1:
                ((self.only[state], self.to[state]),) = out.items()
        self.dense = dense.ravel()

    @property
    def nbytes(self) -> int:
        return self.only.nbytes + self.to.nbytes + self.row.nbytes + self.dense.nbytes

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states that `symbol` leads to, -1 where it leads nowhere."""
        return np.where(self.only[state] == symbol, self.to[state], self.dense[self.row[state] * self.width + symbol])


class Model:
    """Suffix automata of the languages' samples, of `most` bytes or less."""

    def __init__(self, texts: dict[str, bytes], most: int = MODEL_BYTES):
        self.langs = sorted(texts)
        seen = np.zeros(256, np.int64)
        for text in texts.values():
            seen += np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        self.classes = np.zeros(256, np.uint16)  # class 0: in no sample
        used = np.flatnonzero(seen)
        self.classes[used] = np.arange(1, len(used) + 1)
        width, share, parts = len(used) + 1, most / len(texts), texts
        while True:
            self.texts = parts
            self.automata = [Automaton(parts[lang], self.classes, width) for lang in self.langs]
            over = max(a.nbytes for a in self.automata) / share
            longest = max(len(t) for t in parts.values())
            if over <= 1 or longest < 64:
                break
            parts = {lang: text[: int(longest / over * 0.95)] for lang, text in parts.items()}
        self.learned = [len(self.texts[lang]) for lang in self.langs]

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each text in each language (documents x languages).

        A text is parsed from its start to its end into longest matches, each with the symbol
        that ends it; a match that the text's end cuts off is a phrase too.

        Stretches of the texts are parsed side by side as if a phrase began with each. Two
        parses that end a phrase at one place go on alike, so the parse of a stretch is led on
        into the next until both end a phrase together; only from there on the next one's own
        parse counts. One that never meets the next is led on through it, into the one after.
        """
        sizes = np.diff(offsets)
        pieces = -(-sizes // STRETCH)
        first = np.cumsum(pieces) - pieces
        doc = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(doc)) - np.repeat(first, pieces)
        start = offsets[:-1][doc] + nth * STRETCH
        length = np.minimum(offsets[1:][doc] - start, STRETCH)
        symbols = self.classes[data]
        out = np.zeros((len(sizes), len(self.automata)))
        for lang, automaton in enumerate(self.automata):
            out[:, lang] = self._counted(automaton, symbols, doc, start, length, len(sizes))
        return out

    @staticmethod
    def _counted(automaton: Automaton, symbols: np.ndarray, doc: np.ndarray, start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
        ended = np.zeros(len(symbols) + 1, bool)  # where the stretch's own parse ends a phrase

        def walk(state: np.ndarray, at: np.ndarray, size: np.ndarray, met: np.ndarray | None) -> tuple[np.ndarray, ...]:
            """Leads `state` over `size` symbols from `at`; its end, the phrases ended, and after how many symbols `met` ended one too (-1: never)."""
            order = np.argsort(-size, kind="stable")
            state, at, size = state[order], at[order], size[order]
            count, place, own = np.zeros(len(size), np.int64), np.full(len(size), -1, np.int64), np.arange(len(size))
            end = state.copy()
            for t in range(int(size[0]) if len(size) else 0):
                alive = int(np.searchsorted(-size, -t, side="left"))
                if alive < len(own):
                    end[own[alive:]] = state[alive:]
                    own, at, state, size = own[:alive], at[:alive], state[:alive], size[:alive]
                if not alive:
                    break
                to = automaton.step(state, symbols[at + t])
                missed = to < 0
                to[missed] = 0  # the symbol that no match goes on with ends the phrase
                state = to
                if met is None:
                    ended[at + t] = missed
                    count[own] += missed
                else:
                    count[own] += missed
                    together = missed & met[at + t]
                    if together.any():
                        place[own[together]] = t + 1
                        stay = ~together
                        own, at, state, size = own[stay], at[stay], state[stay], size[stay]
            end[own] = state
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            return end[back], count[back], place[back]

        state, count, _ = walk(np.zeros(len(doc), np.int32), start, length, None)
        # each stretch's parse is led on into the next of its text, and on through those that it doesn't meet
        meets, place, phrases, last = np.full(len(doc), -1, np.int64), np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64), state.copy()
        lane, into = np.arange(len(doc)), np.arange(len(doc)) + 1
        while True:
            more = into < len(doc)
            more[more] = doc[into[more]] == doc[lane[more]]
            lane, into = lane[more], into[more]
            if not len(lane):
                break
            end, counted, where = walk(last[lane], start[into], length[into], ended)
            phrases[lane] += counted
            last[lane] = end
            done = where >= 0
            meets[lane[done]], place[lane[done]] = into[done], where[done]
            lane, into = lane[~done], into[~done] + 1
        return _followed(doc, start, count, ended, meets, place, phrases, last, n)


def _followed(doc: np.ndarray, start: np.ndarray, count: np.ndarray, ended: np.ndarray, meets: np.ndarray, place: np.ndarray, phrases: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Phrases of each text, along the stretches whose parses count: from the first to the one it meets, and so on."""
    before = np.append(0, np.cumsum(ended))
    total = np.zeros(n)
    heads = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    at, entered = heads, np.zeros(len(heads), np.int64)
    while len(at):
        # of a stretch entered within, the phrases up to there are those of the parse that came in
        skipped = before[start[at] + entered] - before[start[at]]
        total[doc[at]] += count[at] - skipped + phrases[at]
        going = meets[at] >= 0
        total[doc[at[~going]]] += last[at[~going]] != 0  # the text's end cuts a match off
        at, entered = meets[at[going]], place[at[going]]
    return total


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, model_bytes: int = MODEL_BYTES) -> Model | None:
    """A model of all languages in `docs`, from at most `sample_docs` texts and `sample_bytes` bytes of each.

    The texts are drawn by a hash of id and text, so a rerun takes the same; of a text longer
    than an eighth of `sample_bytes` a stretch of that length is taken, from a place drawn in
    the same way. The model's automata take `model_bytes` at most together: with many languages
    each learns from less. Rows with a null language, or a text that is null or has no letter,
    are left out. None if nothing is labelled.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(LETTER)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    counts = labelled.groupBy("lang").count().collect()
    if not counts:
        return None
    # a state takes some 70 bytes a byte of text; what can't be learned isn't fetched either
    sample_bytes = max(64, min(sample_bytes, model_bytes // (20 * len(counts))))
    piece = max(16, sample_bytes // 8)
    hashed = F.xxhash64("id", "text")
    draw = F.pmod(hashed, F.lit(1 << 30)) / float(1 << 30)
    share = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, sample_docs / r["count"]))]), F.col("lang"))
    from_ = F.pmod(F.shiftrightunsigned(hashed, 32), F.greatest(F.length("text") - piece + 1, F.lit(1))).cast("int") + 1
    some = labelled.where(draw < share)
    rows = some.select("lang", F.substring("text", from_, F.lit(piece)).alias("text"), draw.alias("draw")).orderBy("draw", "lang", "text").limit(2 * sample_docs * len(counts)).collect()
    texts: dict[str, list[str]] = {}
    room = {r["lang"]: sample_bytes for r in counts}
    for row in rows:
        if room[row["lang"]] > 0:
            part = row["text"][: room[row["lang"]]]
            texts.setdefault(row["lang"], []).append(part)
            room[row["lang"]] -= len(part.encode())
    # equal amounts, or a language learned from more text would need fewer phrases
    joined = {lang: folded(pa.array(["\n".join(parts)]))[0].as_py().encode() for lang, parts in texts.items()}
    return Model(joined, model_bytes)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred and score: the language whose sample parses the text into the fewest phrases.

    Each text is parsed whole, from its start to its end. Phrases are normalised by the
    logarithm of the amount learned. score is 1 less the best
    language's share of the two best languages' phrases, doubled and clipped: 0 if they tie, 1
    if the best needs none. Ties go to the language that sorts first.

    Null text, or text without a letter: lang_pred `und`, score 0; so too if there is no model.
    Repeated rows are alike. An empty table gives an empty result. Columns of `docs` named
    lang_pred or score are replaced; `_letter` is reserved; no other column is read. The model
    is broadcast, and is bounded (see `learn`).
    """
    schema = T.StructType([f for f in docs.schema if f.name not in ("lang_pred", "score", "_letter")] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    passed = schema.fieldNames()[:-2]
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = handle.value
        for batch in B.as_batch(batches, text_col):
            known = batch.column("_letter").to_numpy(zero_copy_only=False).astype(bool)
            names, scores = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            if model is not None and known.any():
                counts = model.phrases(*B.text_of(folded(batch.column(text_col)))) + 1.0
                counts *= np.log(np.array(model.learned))
                order = np.argsort(counts, axis=1, kind="stable")
                best = counts[np.arange(len(counts)), order[:, 0]]
                second = counts[np.arange(len(counts)), order[:, 1]] if len(model.langs) > 1 else 3 * best
                names[known] = np.array(model.langs, object)[order[known, 0]]
                scores[known] = np.clip(1 - 2 * best / (best + second), 0, 1)[known]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), pa.array(names, pa.string()), pa.array(scores)], names=schema.fieldNames())

    letter = F.coalesce(F.col(text_col).rlike(LETTER), F.lit(False))
    return docs.withColumn("_letter", letter).select(*passed, "_letter").mapInArrow(predict, schema)
