"""MinHash near-dedup on HyperMinHash registers, with exact verification of every link."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import blocks as B
from colloquy.llm.components import components
from colloquy.llm.shared import stored

#: Bands and registers in each. At a similarity of 0.8 a pair misses all with a probability of 1e-7, at 0.85 of 7e-11.
BANDS, ROWS = 40, 5
BUCKETS = BANDS * ROWS
MANTISSA_BITS = 10
#: Standard errors by which an estimate may lie under the threshold and still be verified.
SLACK = 5.0
#: Rows of a bucket that one task compares with as many others.
BLOCK = 2000
#: Bytes of a table of bits that says which sets of a block pair hold which members; beyond it posting lists are counted.
BITMAP_BYTES = 64 << 20
#: Stands for a null id while links are sought.
NO_ID = -(2**63)

_rng = np.random.Generator(np.random.PCG64(77))
_TRIES = _rng.integers(0, BUCKETS, (24, BUCKETS))
_ORDER = np.argsort(_rng.random((BUCKETS, BUCKETS)), axis=1)
_BAND = _rng.integers(1, 2**62, (BANDS, ROWS)).astype(B.U64) * B.U64(2) + B.U64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed word shingles of each document, sorted, and where each document's begin (and the number of all).

    A document of fewer words than `words` has its whole sequence as one shingle; one without words has none.
    """
    data = B.LOWER[data]
    starts, ends, first = B.words_of(data, offsets)
    codes = B.word_hashes(data, starts, ends)
    grams = B.gram_hashes(codes, words)
    n = np.diff(first)
    inside = np.flatnonzero(B.whole(first, words, len(grams)))
    short = np.flatnonzero((n > 0) & (n < words))
    hashes, docs = grams[inside], np.searchsorted(first, inside, side="right") - 1
    if len(short):
        sums = B.sums_of(codes)
        hashes = np.append(hashes, B.range_hash(sums, first[short], first[short + 1]))
        docs = np.append(docs, short)
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    hashes, docs = hashes[new], docs[new]
    return hashes, np.searchsorted(docs, np.arange(len(offsets)))


def set_ids(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit number of each set, the same for equal sets."""
    sums = np.append(B.U64(0), np.cumsum(B.mix(hashes ^ B.U64(0x5851F42D4C957F2D))))
    return B.mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(B.U64)).astype(np.int64)


def registers_of(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """HyperMinHash registers of each set (documents x BUCKETS, uint16), and how many buckets the set itself fills.

    A hash's top bits choose the bucket; of the least hash there, the register holds the count
    of leading zeros and the MANTISSA_BITS bits after the first one. A bucket that no hash
    falls in borrows from another, tried in an order that depends on the bucket alone.
    """
    n = len(first) - 1
    docs = np.repeat(np.arange(n), np.diff(first))
    bucket = ((hashes >> B.U64(32)) * B.U64(BUCKETS)) >> B.U64(32)
    slot = docs * BUCKETS + bucket.astype(np.int64)
    lead = np.ones(len(slot), bool)
    lead[1:] = slot[1:] != slot[:-1]
    within = hashes[lead] * B.U64(BUCKETS)
    fraction, exponent = np.frexp(within.astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 63)
    mantissa = np.clip((fraction * 2 - 1) * (1 << MANTISSA_BITS), 0, (1 << MANTISSA_BITS) - 1)
    flat, filled = np.zeros(n * BUCKETS, np.uint16), np.zeros(n * BUCKETS, bool)
    flat[slot[lead]] = (zeros.astype(np.uint16) << MANTISSA_BITS) | mantissa.astype(np.uint16)
    filled[slot[lead]] = True
    own = filled.reshape(n, BUCKETS)
    counts = own.sum(1)
    row, col = np.nonzero(~own & (counts > 0)[:, None])
    for tries in _TRIES:
        if not len(row):
            break
        from_ = row * BUCKETS + tries[col]
        ok = filled[from_]
        flat[row[ok] * BUCKETS + col[ok]] = flat[from_[ok]]
        row, col = row[~ok], col[~ok]
    for a in range(0, len(row), 4096):
        r, c = row[a : a + 4096], col[a : a + 4096]
        pick = np.argmax(own[r[:, None], _ORDER[c]], axis=1)
        flat[r * BUCKETS + c] = flat[r * BUCKETS + _ORDER[c, pick]]
    return flat.reshape(n, BUCKETS), counts


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band (documents x BANDS); bands of unlike place never share one but by chance."""
    x = registers.astype(B.U64).reshape(-1, BANDS, ROWS)
    return B.mix((B.mix(x + B.U64(1)) * _BAND).sum(axis=2, dtype=B.U64) + np.arange(BANDS, dtype=B.U64))


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates from registers, corrected for registers of unlike sets that agree by chance.

    Two independent minima share their leading zeros with a probability of about 1/3 and then
    the mantissa with one of 2**-MANTISSA_BITS.
    """
    chance = 2.0**-MANTISSA_BITS / 3
    return np.maximum(((a == b).mean(axis=-1) - chance) / (1 - chance), 0)


def _sketch(id_col: str, text_col: str, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.as_batch(batches, text_col):
            hashes, first = shingle_sets(*B.text_of(batch.column(text_col)), words)
            n = np.diff(first)
            registers, filled = registers_of(hashes, first)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(set_ids(hashes, first)), pa.array(filled, pa.int32()), pa.array([r.tobytes() for r in registers], pa.binary())],
                names=["id", "n_shingles", "node", "filled", "registers"],
            )

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            registers = np.frombuffer(b"".join(part.column("registers").to_pylist()), np.uint16).reshape(-1, BUCKETS)
            keys = band_keys(registers).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column("node").to_numpy(), BANDS))], names=["band", "node"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def _plausible(a: np.ndarray, b: np.ndarray, filled: np.ndarray, threshold: float) -> np.ndarray:
    return estimated(a, b) >= threshold - SLACK * np.sqrt(threshold * (1 - threshold) / np.maximum(filled, 1))


def _estimate(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                filled = np.minimum(part.column("filled_a").to_numpy(), part.column("filled_b").to_numpy())
                keep = _plausible(_matrix(part.column("registers_a")), _matrix(part.column("registers_b")), filled, threshold)
                yield part.select(["a", "b"]).filter(pa.array(keep))

    return run


class Forest:
    """Union-find over small numbers; `join` says whether two were apart."""

    def __init__(self, labels: np.ndarray):
        _, self.up = np.unique(labels, return_inverse=True)
        self.at = self.up.copy()
        self.up = np.arange(self.at.max() + 1 if len(self.at) else 0)

    def root(self, i: int) -> int:
        x = self.at[i]
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def roots(self) -> np.ndarray:
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return self.up[self.at]

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _joined(group: pa.Table, linked) -> pa.Table:
    """Edges (a, b) that join components of one block pair, where `linked(i, others)` says which of `others` go with i.

    A row is compared with those rows only that no edge has brought into its component yet,
    and an edge goes out only if it joins two components.
    """
    side, node, comp = (group.column(c).to_numpy() for c in ("side", "node", "comp"))
    left, right = (side & 1).nonzero()[0], (side & 2).nonzero()[0]
    same = bool((side == 3).all())
    forest = Forest(comp)
    a, b = [], []
    for n, i in enumerate(left):
        rest = right[n + 1 :] if same else right
        others = rest[forest.roots()[rest] != forest.root(i)]
        for j in others[linked(i, others)] if len(others) else ():
            if forest.join(i, j):
                a.append(min(node[i], node[j]))
                b.append(max(node[i], node[j]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _plausible_joins(threshold: float):
    """Edges of plausible estimates that join the components in one block pair of a bucket."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        registers, filled = _matrix(group.column("registers")), group.column("filled").to_numpy()
        return _joined(group, lambda i, others: _plausible(registers[i], registers[others], np.minimum(filled[i], filled[others]), threshold))

    return run


def _verified_joins(percent: int, bitmap_bytes: int):
    """Links, by the full sets, that join the components in one block pair of a plausible cluster."""

    def run(group: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, B.U64) for x in group.column("members").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        tokens, number, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        # only members that two sets or more share count towards an intersection
        shared = counts[number] > 1
        number, owner = (np.cumsum(counts > 1) - 1)[number[shared]], owner[shared]
        width = (int((counts > 1).sum()) + 63) // 64
        if len(sets) * width * 8 <= bitmap_bytes:
            bits = np.zeros((len(sets), width), B.U64)
            np.bitwise_or.at(bits, (owner, number // 64), B.U64(1) << (number % 64).astype(B.U64))
            common = lambda i, others: np.bitwise_count(bits[i] & bits[others]).sum(axis=1, dtype=np.int64)
        else:
            by_token, first = np.argsort(number, kind="stable"), np.searchsorted(np.sort(number), np.arange(int((counts > 1).sum()) + 1))
            own = np.searchsorted(owner, np.arange(len(sets) + 1))

            def common(i, others):
                at = number[own[i] : own[i + 1]]
                n = first[at + 1] - first[at]
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at], n)
                return np.bincount(owner[by_token[place]], minlength=len(sets))[others]

        def linked(i, others):
            both = common(i, others)
            return 100 * both >= percent * (sizes[i] + sizes[others] - both)

        return _joined(group, linked)

    return run


def _crowded(placed: DataFrame, key: str) -> DataFrame:
    """(key, _top, _n_top, _n_rest) of each `key` whose rows (key, comp) are of several components: the largest, its rows, and all others'."""
    sizes = placed.groupBy(key, "comp").agg(F.count(F.lit(1)).alias("n"))
    groups = sizes.groupBy(key).agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    return groups.where("k > 1").select(key, F.col("top.comp").alias("_top"), F.col("top.n").alias("_n_top"), (F.col("n") - F.col("top.n")).alias("_n_rest"))


def _blocked(df: DataFrame, key: str, others: list[str]) -> DataFrame:
    """Rows of each crowded `key` dealt to pairs (i, j) of blocks of BLOCK rows; side says on which side of the pair a row is.

    Rows of the largest component need no comparison with each other: they have blocks of their
    own, which meet the other components' blocks only. So a large group in which few rows are
    still apart is copied a few times, not once for each of its blocks.
    """
    rest, top = (F.greatest(F.ceil(F.col(c) / BLOCK), F.lit(1)).cast("int") for c in ("_n_rest", "_n_top"))
    inner = F.col("comp") == F.col("_top")
    draw = F.xxhash64("node")
    own = F.when(inner, rest + F.pmod(draw, top)).otherwise(F.pmod(draw, rest)).cast("int")
    meets = F.sequence(F.lit(0), F.when(inner, rest).otherwise(rest + top) - 1)
    dealt = df.withColumn("_own", own).withColumn("_other", F.explode(meets))
    side = F.when(F.col("_own") == F.col("_other"), 3).when(F.col("_own") < F.col("_other"), 1).otherwise(2)
    return dealt.select(key, F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), side.alias("side"), "node", "comp", *others)


def _sets(text_col: str, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.as_batch(batches, text_col):
            hashes, first = shingle_sets(*B.text_of(batch.column(text_col)), words)
            nodes = batch.column("node").to_numpy()
            # a row may share its id with the representative and hold another text
            own = np.flatnonzero(set_ids(hashes, first) == nodes)
            sets = [hashes[first[i] : first[i + 1]].tobytes() for i in own]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(sets, pa.binary())], names=["node", "members"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("members_a"), batch.column("members_b")):
                x, y = np.frombuffer(x.as_buffer(), B.U64), np.frombuffer(y.as_buffer(), B.U64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bitmap_bytes: int = BITMAP_BYTES) -> DataFrame:
    """Rows (id_col, n_shingles, component_id, kept), one for each of `docs`.

    A-Z are lower-cased; a text's set is its distinct shingles of `words` words
    `[^\\x20\\x09-\\x0D]+`, or its whole sequence if it has fewer. Two texts are linked if their
    intersection holds `percent` hundredths of their union or more; component_id is the least id
    that links reach, and kept says that it is the row's own.

    Texts of equal sets form a class, and one of each class goes on. HyperMinHash registers are
    banded. In each bucket every class is compared with the least one, by the corrected
    estimate and then on the full sets. Where a bucket holds classes of more than one component
    after that, estimates across components tell which may belong together; these clusters are
    compared on the full sets, in blocks. Only edges that join components leave a block, so a
    large group makes as many rows as it has members; no cap applies, and no link is reported
    that does not hold, as far as 64-bit hashes tell sets and shingles apart. Blocks of sets
    are compared as bitmaps of `bitmap_bytes` or less, and by posting lists beyond.

    Null or empty text, or one without words: an empty set, linked with nothing. A null id
    counts as the least. Rows with equal ids are each a text of their own. Extra columns of `docs` are not read. An empty table gives an
    empty result.
    """
    spark, threshold = docs.sparkSession, percent / 100
    source = docs.select(F.coalesce(F.col(id_col), F.lit(NO_ID)).cast("long").alias("id"), F.col(text_col).alias("text"))
    base = stored(source.mapInArrow(_sketch("id", "text", words), "id long, n_shingles long, node long, filled int, registers binary"), "registers")
    whole = base.where("n_shingles > 0")
    classes = stored(whole.groupBy("node").agg(F.min("id").alias("least")), "classes")
    chosen = whole.join(classes.select("node", F.col("least").alias("id")), ["node", "id"])
    reps = stored(chosen.dropDuplicates(["node"]).select("node", "id", "filled", "registers"), "representatives")
    bands = stored(reps.select("node", "registers").mapInArrow(_bands, "band long, node long"), "bands")
    centers = bands.groupBy("band").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "a")
    stars = stored(bands.join(centers, "band").where("node > a").select("a", F.col("node").alias("b")).distinct(), "stars")

    def members_of(nodes: DataFrame) -> DataFrame:
        """Full sets of `nodes`, stored."""
        needed = reps.select("node", "id").join(nodes.distinct(), "node")
        members = source.join(needed.hint("shuffle_hash"), "id").select("node", "text").mapInArrow(_sets("text", words), "node long, members binary")
        return stored(members.dropDuplicates(["node"]), "sets")

    side = reps.select("node", "filled", "registers")
    plausible = stars.join(side.toDF("a", "filled_a", "registers_a"), "a").join(side.toDF("b", "filled_b", "registers_b"), "b").mapInArrow(_estimate(threshold), "a long, b long")
    plausible = stored(plausible, "plausible")
    sets = members_of(plausible.select(F.explode(F.array("a", "b")).alias("node")))
    both = plausible.join(sets.toDF("a", "members_a"), "a").join(sets.toDF("b", "members_b"), "b")
    links = stored(both.mapInArrow(_verify(percent), "a long, b long"), "links")
    del both
    comps = components(links, "a", "b")

    # buckets that hold several components: which of these may belong together
    placed = bands.join(comps, "node", "left").select("band", "node", F.coalesce("root", "node").alias("comp"))
    spread = _blocked(placed.join(_crowded(placed, "band"), "band").join(side, "node"), "band", ["filled", "registers"])
    may = stored(spread.groupBy("band", "i", "j").applyInArrow(_plausible_joins(threshold), "a long, b long").distinct(), "plausible-joins")
    del placed, spread
    if not may.isEmpty():
        # clusters of components that plausible edges hold together, verified on the full sets
        clusters = components(may.unionByName(links), "a", "b").withColumnRenamed("root", "cluster")
        named = clusters.join(comps, "node", "left").select("cluster", "node", F.coalesce("root", "node").alias("comp"))
        inside = stored(named.join(_crowded(named, "cluster"), "cluster"), "open-clusters")
        spread = _blocked(inside.join(members_of(inside.select("node")), "node"), "cluster", ["members"])
        more = stored(spread.groupBy("cluster", "i", "j").applyInArrow(_verified_joins(percent, bitmap_bytes), "a long, b long"), "links")
        comps = components(links.unionByName(more), "a", "b")
    least = comps.join(classes.select("node", "least"), "node")
    by_root = least.groupBy("root").agg(F.min("least").alias("smallest"))
    smallest = least.join(by_root, "root").select("node", "smallest")
    named = classes.select("node", "least").join(smallest, "node", "left").select("node", F.coalesce("smallest", "least").alias("component_id"))
    out = base.select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node")).join(named, "node", "left")
    out = out.select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    own = F.col("id") == F.col("component_id")
    return out.select(F.nullif("id", F.lit(NO_ID)).alias(id_col), "n_shingles", F.nullif("component_id", F.lit(NO_ID)).alias("component_id"), own.alias("kept"))
