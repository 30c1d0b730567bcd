"""Main text of HTML pages by a conditional random field over their leaf blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import blocks as B
from colloquy.llm.crf import Field, decoded, fit
from colloquy.llm.dom import Block, Frame, Frames, blocks_of
from colloquy.llm.layouts import labelled

#: Pages that the field is trained on, at most; the longest page taken, in bytes; and layouts made of their texts.
SAMPLE_PAGES, SAMPLE_BYTES, DRESSINGS = 400, 50_000, 600
PUNCTUATION = frozenset('.!?:;…"»”')


def text_features(block: Block, title: str) -> tuple[str, ...]:
    """What can be said of a block's own text."""
    text, frame = block.text, block.frame
    around = frame.around or frame
    under = f"{around.around.name if around.around else ''} {around.name}"
    size = min(text.count(" ") + 1, 1023).bit_length()
    linked = -(-4 * block.linked // max(len(text), 1)) if block.linked else 0
    stops = min(text.count(". ") + text.count(", "), 7).bit_length()
    return (
        "any", f"size {size}", f"links {min(linked, 4)}", f"size {size} links {min(linked, 4)}", f"stops {stops}", f"end {text[-1] in PUNCTUATION}",
        f"own {frame.name}", f"own {frame.name} size {size}", f"own {frame.name} under {around.name}", f"own {frame.name} under {under}", f"own {frame.name} within {frame.within}", f"titled {bool(title) and (text.startswith(title) or len(text) > 15 and title.startswith(text))}",
        f"owner {text[0] == '©' or '©' in text[:80]}",
    )


def places(title: str, blocks: list[Block]) -> list[tuple[str, ...]]:
    """Features of each block's text, of its neighbours' and of where it stands, without those of the elements around."""
    own = [text_features(b, title) for b in blocks]
    n, out = len(blocks), []
    for i, said in enumerate(own):
        before = f"before {own[i - 1][3]}" if i else "before none"
        after = f"after {own[i + 1][3]}" if i + 1 < n else "after none"
        same = f"same {i > 0 and blocks[i - 1].frame is blocks[i].frame} {i + 1 < n and blocks[i + 1].frame is blocks[i].frame}"
        out.append((*said, before, after, same, f"at {8 * i // n}"))
    return out


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES, dressings: int = DRESSINGS) -> Field:
    """The field trained on `sample_pages` pages at most, drawn by a hash of id and page, and on layouts made of their texts.

    Null and empty pages, and those over SAMPLE_BYTES, are not drawn; with none left, the layouts
    are all there is to learn from. Hashes under a bound that leaves some four times the sample
    are sorted, so the driver sees no more however many tasks there are.
    """
    size = F.octet_length(html_col)
    able = pages.select(F.xxhash64(id_col, html_col).alias("drawn"), F.col(html_col).alias("html")).where((size > 0) & (size <= SAMPLE_BYTES))
    under = -(2**63) + min(2**64 - 1, 2**66 * sample_pages // max(able.count(), 1))
    drawn = able.where(F.col("drawn") <= under).orderBy("drawn", "html").limit(sample_pages)
    chains = []
    for title, blocks, labels in labelled([r.html for r in drawn.collect()], dressings):
        chains.append(([frozenset(said) | b.frame.said for said, b in zip(places(title, blocks), blocks)], labels))
    return fit(chains)


def main_text(html: str, field: Field, frames: Frames, scores: dict) -> str:
    """The blocks labelled as the article's, joined by an empty line; `scores` keeps what features come to."""

    def of_frame(frame: Frame) -> float:
        if frame.score is None:
            frame.score = sum(field.weights.get(f, 0.0) for f in sorted(frame.said))
        return frame.score

    def of_place(said: tuple[str, ...]) -> float:
        if said not in scores:
            scores[said] = sum(field.weights.get(f, 0.0) for f in said)
        return scores[said]

    title, blocks = blocks_of(html, frames)
    labels = decoded([of_place(said) + of_frame(b.frame) for said, b in zip(places(title, blocks), blocks)], field)
    return "\n\n".join(b.text for b, label in zip(blocks, labels) if label)


def _extract(field: Field, html_col: str):
    known = frozenset(field.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.as_batch(batches, html_col):
            frames, scores = Frames(known), {}
            texts = [main_text(h.decode("utf-8", "replace"), field, frames, scores) if h else "" for h in batch.column(html_col).cast(pa.binary()).to_pylist()]
            columns = {n: batch.column(n) for n in batch.schema.names if n != html_col} | {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def extracted(pages: DataFrame, field: Field, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, the page's main text, and n_chars, its code points.

    A page is cut into leaf blocks; features of a block are the elements around it with their
    classes, ids and roles, and its text's length, links and punctuation, its neighbours' too. The
    field labels the whole sequence by Viterbi, and the blocks of the article are joined by an
    empty line, in page order. Null, empty and textless pages have the text ''. Pages are read whole
    whatever their length, each by itself: rows alike give rows alike, null ids and urls stay null,
    other columns are not read, and an empty table gives no rows.
    """
    made = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("_html"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema.fields[:2])
    told = made.mapInArrow(_extract(field, "_html"), f"{kinds}, text string")
    return told.withColumn("n_chars", F.length("text").cast("long"))
