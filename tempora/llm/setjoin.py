"""Similarity self-join of shingle sets without enumerating pairs of a group.

Units of text (whole documents, or paragraphs) become sets of hashed 5-word shingles.
Equal sets are one node. Nodes that may be similar meet under a key: a caller-given function
of the set makes its keys, such that similar sets share one. The least node under a key is
the key's leader, and every node visits the blocks of its keys' leaders. So a group of
copies, however its keys overlap, gathers in few blocks instead of being paired up key by
key, and rows stay proportional to nodes. A key comes with its reach, the size of the
largest set that can be similar to its own and meet it there; a visit is left out if no
other set under the key is within reach and has this one within its own.

A block is verified in one pass over an inverted index of its sets: starting from any node,
the lists of its shingles are scanned and overlaps counted for all nodes not reached yet;
those that are similar are reached and scanned in turn. This finds the same components as
all pairs would, and emits one link for each node reached. Blocks of more than CHUNK
shingles are split: a task holds one chunk as its index and streams the rest of the block
past it, so memory stays bounded whatever the size of the group.

64-bit hashes stand for shingles and nodes: the chance of any wrong match is about n^2/2^65.

Defined results: units without words have no node and link with nothing; equal sets are one
node, whichever rows they are from; rows may share a doc_id or have none, as what is sent to
a block is told apart by its node; an empty table gives no node; columns of docs other than
doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.llm.common import by_blocks, cached, discard, only, written
from tempora.llm.components import components

SHINGLE = 5
#: 100 * intersection >= PERCENT * union
PERCENT = 75
#: Shingles that a task indexes at once.
CHUNK = 2_000_000
#: Sets that a task knows to have seen, so that copies give their keys once.
REMEMBERED = 200_000
SKETCH_BITS = 22

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class WordHashes(dict):
    """64-bit hash of each word; forgets all when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_hashes = cached(WordHashes())


def keep_hashes() -> None:
    only(_hashes)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at blanks and code points 9 to 13."""
    return (text or "").encode("utf-8", "replace").lower().split()


@dataclass(frozen=True)
class Sets:
    """Sorted distinct shingle hashes of some units, one after another; starts has one more entry than units."""

    flat: np.ndarray
    starts: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.starts)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.flat[self.starts[k] : self.starts[k + 1]]

    def some(self, which: np.ndarray) -> Sets:
        """The sets of these numbers, in rising order."""
        sizes = self.sizes
        kept = np.zeros(len(sizes), bool)
        kept[which] = True
        return Sets(self.flat[np.repeat(kept, sizes)], np.concatenate([[0], np.cumsum(sizes[which])]).astype(np.int64))

    def nodes(self) -> np.ndarray:
        """64-bit ids of the sets, as signed numbers: sums over their members, mixed again. Empty sets have 0."""
        out = np.zeros(len(self.starts) - 1, np.uint64)
        full = np.flatnonzero(self.sizes)
        if len(full):
            out[full] = mixed(np.add.reduceat(mixed(self.flat ^ _MULTIPLIERS[0]), self.starts[full]) + self.sizes[full].astype(np.uint64) * _MULTIPLIERS[1])
        return out.astype(np.int64)


def word_hashes(units: list[list[bytes]]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, chain.from_iterable(units)), np.uint64, sum(map(len, units)))


def shingle_sets(units: list[list[bytes]], hashes: np.ndarray | None = None) -> Sets:
    """The sets of all runs of 5 words of each unit; fewer words are one run, none is empty."""
    lengths = np.array([len(w) for w in units], np.int64)
    n = int(lengths.sum())
    h = word_hashes(units) if hashes is None else hashes
    unit = np.repeat(np.arange(len(units), dtype=np.uint16 if len(units) < 65536 else np.int64), lengths)
    m = max(0, n - SHINGLE + 1)
    total = h[:m] * _MULTIPLIERS[0]
    for k in range(1, SHINGLE):
        total += h[k : m + k] * _MULTIPLIERS[k]
    inside = unit[:m] == unit[n - m :]
    value, owner = mixed(total[inside]), unit[:m][inside]
    short = np.flatnonzero((lengths > 0) & (lengths < SHINGLE))
    if len(short):
        ends = np.cumsum(lengths)
        own = [mixed((h[ends[k] - lengths[k] : ends[k]] * _MULTIPLIERS[: lengths[k]]).sum(keepdims=True) + np.uint64(lengths[k])) for k in short.tolist()]
        value, owner = np.concatenate([value, *own]), np.concatenate([owner, short.astype(owner.dtype)])
    order = np.argsort(value)
    order = order[np.argsort(owner[order], kind="stable")]
    value, owner = value[order], owner[order]
    first = np.ones(len(value), bool)
    first[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[first], owner[first]
    return Sets(value, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(units)))]).astype(np.int64))


#: Unit number and words of units of a text, in order.
Parts = list[tuple[int, list[bytes]]]
#: From the units of some texts, and the hashes of all their words, to their fingerprints: number of the text, first word, key, first and last unit.
Prints = Callable[[list[Parts], np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Units:
    """How texts become units: split gives (unit number, words), those of `least` words and more take part.

    With `prints`, described() also gives fingerprints of the words of all units.
    """

    split: Callable[[str | None], Parts]
    least: int = 0
    prints: Prints | None = None

    def taking_part(self, text: str | None) -> Parts:
        return [part for part in self.split(text) if len(part[1]) >= self.least]


def whole(text: str | None) -> list[tuple[int, list[bytes]]]:
    return [(0, words_of(text))]


def described(docs: DataFrame, units: Units, sketch: bool) -> DataFrame:
    """doc_id, digest (of the row's text), unit, n_words, size, node of every unit; with `sketch` also rows of counts.

    The sketch counts all shingles of the corpus in 2^SKETCH_BITS cells by their low bits.
    Its rows have a slice number and compressed 4-byte counts instead of a unit. With
    `units.prints` there are also rows of fingerprints: size -1, the first word as unit, the
    key as node, and the first and last unit that it lies in.
    """
    cells, per = 1 << SKETCH_BITS, 1 << 14
    names, places = ["doc_id", "digest", "unit", "n_words", "size", "node", "counts"], ["first", "last"] if units.prints else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_hashes()
        counts = np.zeros(cells, np.uint32) if sketch else None
        for batch in batches:
            for block in by_blocks(batch, "text"):
                rows, parts, texts = [], [], []
                ids, digests = block.column(0), block.column(2)
                for doc_id, text, digest in zip(ids.to_pylist(), block.column(1).to_pylist(), digests.to_pylist(), strict=True):
                    split = units.split(text)
                    if units.prints:
                        texts.append(split)
                    for unit, words in split:
                        if len(words) >= units.least:
                            rows.append((doc_id, digest, unit, len(words)))
                            parts.append(words)
                hashes = own = None
                if units.prints:
                    every = [words for split in texts for _, words in split]
                    hashes, lengths = word_hashes(every), np.array([len(words) for words in every], np.int64)
                    own = hashes[np.repeat(lengths >= units.least, lengths)]
                sets = shingle_sets(parts, own)
                if counts is not None:
                    counts += np.bincount((sets.flat & np.uint64(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint32)
                yield as_batch([(*r, n, node if n else None) for r, n, node in zip(rows, sets.sizes.tolist(), sets.nodes().tolist(), strict=True)])
                if units.prints:
                    owner, at, key, first, last = units.prints(texts, hashes)
                    n = len(at)
                    columns = [ids.take(pa.array(owner)), digests.take(pa.array(owner)), pa.array(at, pa.int32()), pa.nulls(n, pa.int32()), pa.array(np.full(n, -1, np.int32)), pa.array(key.view(np.int64)), pa.nulls(n, pa.binary())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(first, pa.int32()), pa.array(last, pa.int32())], [*names, *places])
        if counts is not None and counts.any():
            for k in range(0, cells, per):
                yield as_batch([(None, None, k // per, 0, 0, None)], [zlib.compress(counts[k : k + per].tobytes(), 1)])

    def as_batch(rows: list[tuple], cells_: list[bytes] | None = None) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
        columns.append(pa.array(cells_ or [None] * len(rows), pa.binary()))
        columns += [pa.nulls(len(rows), pa.int32()) for _ in places]
        return pa.RecordBatch.from_arrays(columns, [*names, *places])

    schema = "doc_id long, digest long, unit int, n_words int, size int, node long, counts binary" + "".join(f", {p} int" for p in places)
    return docs.select("doc_id", "text", F.xxhash64("text").alias("digest")).mapInArrow(run, schema)


def summed_sketch(rows: DataFrame) -> np.ndarray:
    """The sketch over all partitions: 2^SKETCH_BITS counts, whatever the size of the corpus."""
    import pandas as pd

    def summed(packed) -> bytes:
        total = np.zeros(1 << 14, np.uint64)
        for c in packed:
            total += np.frombuffer(zlib.decompress(c), np.uint32)
        return zlib.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"unit": part["unit"].iloc[:1], "counts": [summed(part["counts"])]})

    def add_some(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            by = part.groupby("unit")["counts"].apply(summed).reset_index()
            yield by[["unit", "counts"]]

    some = rows.where(F.col("counts").isNotNull()).select("unit", "counts").mapInPandas(add_some, "unit int, counts binary")
    got = some.groupBy("unit").applyInPandas(add, "unit int, counts binary").collect()
    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    for unit, c in got:
        out[unit << 14 : (unit + 1) << 14] = np.frombuffer(zlib.decompress(c), np.uint32)
    return out


#: From sets to their keys: key, reach and number of the set, as three arrays.
Keys = Callable[[Sets], tuple[np.ndarray, np.ndarray, np.ndarray]]


def postings(docs: DataFrame, units: Units, keys: Keys) -> DataFrame:
    """(key, node, size, reach) for all keys of all units; a task gives equal sets' keys once for up to REMEMBERED sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_hashes()
        seen: set[int] = set()
        for batch in batches:
            for block in by_blocks(batch, "text"):
                sets = shingle_sets([words for text in block.column(0).to_pylist() for _, words in units.taking_part(text)])
                fresh = []
                for k, node in enumerate(sets.nodes().tolist()):
                    if node not in seen:
                        seen.add(node)
                        fresh.append(k)
                if len(seen) > REMEMBERED:
                    seen.clear()
                sets = sets.some(np.array(fresh, np.int64))
                key, reach, owner = keys(sets)
                columns = [key.astype(np.int64), sets.nodes()[owner], sets.sizes[owner].astype(np.int32), reach.astype(np.int32)]
                for at in range(0, len(key), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 17)]) for c in columns], ["key", "node", "size", "reach"])

    return docs.select("text").mapInArrow(run, "key long, node long, size int, reach int")


def visits(posted: DataFrame) -> DataFrame:
    """(node, leader): the blocks that each node goes to.

    Keys of a single node lead nowhere. Under a key, by size: of the sets before, the one
    with the farthest reach must reach this one, and the least must be within this one's
    reach; or the next set must be within reach, and some set after must reach back.
    """
    key = Window.partitionBy("key")
    before = key.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    after = key.orderBy("size").rowsBetween(1, Window.unboundedFollowing)
    led = posted.select(
        "node",
        F.min("node").over(key).alias("leader"),
        F.max("node").over(key).alias("last"),
        ((F.max("reach").over(before) >= F.col("size")) & (F.min("size").over(before) <= F.col("reach"))).alias("smaller"),
        ((F.min("size").over(after) <= F.col("reach")) & (F.max("reach").over(after) >= F.col("size"))).alias("larger"),
    )
    return led.where("leader <> last and (smaller or larger)").select("node", "leader").distinct()


class Index:
    """Inverted lists over some sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]

    def overlaps(self, s: np.ndarray) -> np.ndarray:
        """Shingles that each set has in common with s."""
        lo, hi = np.searchsorted(self.flat, s, "left"), np.searchsorted(self.flat, s, "right")
        n = hi - lo
        total = int(n.sum())
        if not total:
            return np.zeros(len(self.sizes), np.int64)
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
        return np.bincount(self.owner[at], minlength=len(self.sizes))

    def similar(self, s: np.ndarray) -> np.ndarray:
        both = self.overlaps(s)
        return np.flatnonzero((100 * both >= PERCENT * (self.sizes + len(s) - both)) & (both > 0))


def reached(sets: list[np.ndarray]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that span the components of the sets, and each set's component number."""
    n = len(sets)
    label = np.full(n, -1, np.int64)
    links: list[tuple[int, int]] = []
    left = np.arange(n)  # sets that the index holds
    index = Index(sets)
    for root in range(n):
        if label[root] >= 0:
            continue
        label[root] = root
        open_ = [root]
        while open_:
            if len(left) > 64 and (label[left] < 0).sum() * 2 < len(left):
                left = left[label[left] < 0]
                if not len(left):
                    return links, label
                index = Index([sets[i] for i in left])
            x = open_.pop()
            found = left[index.similar(sets[x])]
            found = found[label[found] < 0]
            label[found] = root
            for y in found.tolist():
                links.append((x, y))
                open_.append(y)
    return links, label


def block_links(docs: DataFrame, units: Units, rel: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between nodes, that span the components of the similarity graph.

    rel: (node, leader); nodes: (node, doc_id, unit, size) of one unit for each node.
    """
    placed = rel.join(nodes, "node")
    chunks = placed.groupBy("leader").agg(F.ceil(F.sum("size") / F.lit(CHUNK)).cast("int").alias("chunks"))
    placed = placed.join(chunks, "leader").withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    placed = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    wanted = placed.groupBy("doc_id").agg(F.collect_list(F.struct("unit", "node", "leader", "chunk", (F.col("chunk") == F.col("own")).alias("member"))).alias("to"))
    wanted = wanted.withColumnRenamed("doc_id", "wanted")
    sent = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted"))).select("text", "to")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in by_blocks(batch, "text", 1 << 20):
                rows = []
                for text, to in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                    by_unit = dict(units.taking_part(text))
                    for t in to:
                        if t["unit"] in by_unit:
                            rows.append((t["leader"], t["chunk"], t["member"], t["node"], b" ".join(by_unit[t["unit"]])))
                kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()]
                for at in range(0, len(rows), 2000):
                    part = rows[at : at + 2000]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, t in enumerate(kinds)], ["leader", "chunk", "member", "node", "words"])

    rows = sent.mapInArrow(spread, "leader long, chunk int, member boolean, node long, words binary")
    rows = rows.repartition("leader", "chunk").sortWithinPartitions("leader", "chunk", F.desc("member"), "node")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

        at = index = label = None
        ids: list[int] = []
        sets: list[np.ndarray] = []

        def close() -> list[tuple[int, int]]:
            nonlocal index, label
            if index is not None or not sets:
                return []
            if len(sets) == 1:
                index, label = Index(sets), np.zeros(1, np.int64)
                return []
            links, label = reached(sets)
            index = Index(sets) if at is not None else None
            return [(ids[i], ids[j]) for i, j in links]

        for batch in batches:
            links: list[tuple[int, int]] = []
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            made = shingle_sets([r[4].split(b" ") for r in rows])
            for k, ((leader, chunk, member, node, _), got) in enumerate(zip(rows, made.nodes().tolist(), strict=True)):
                if got != node:
                    continue  # another row with the same doc_id
                s = made[k]
                if at != (leader, chunk):
                    links += close()
                    at, index, label, ids, sets = (leader, chunk), None, None, [], []
                if member:
                    if not ids or ids[-1] != node:
                        ids.append(node)
                        sets.append(s)
                elif sets:
                    links += close()
                    found = index.similar(s)
                    _, first = np.unique(label[found], return_index=True)
                    links += [(node, ids[i]) for i in found[first].tolist()]
            yield out(links)
        yield out(close())

    return rows.mapInArrow(verify, "a long, b long")


def clustered(spark: SparkSession, docs: DataFrame, units: Units, make_keys: Callable[[np.ndarray | None], Keys], sketch: bool) -> tuple[DataFrame, DataFrame]:
    """(units: doc_id, digest, unit, n_words, size, node; classes: node, component) of the similarity graph.

    Nodes without a link are not in classes. make_keys gets the sketch, or None.
    """
    return classes_of(spark, docs, written(spark, described(docs, units, sketch), "units"), units, make_keys, sketch)


def classes_of(spark: SparkSession, docs: DataFrame, rows: DataFrame, units: Units, make_keys: Callable[[np.ndarray | None], Keys], sketch: bool) -> tuple[DataFrame, DataFrame]:
    """clustered() from the rows that described() gave."""
    counts = summed_sketch(rows) if sketch else None
    units_df = rows.where(F.col("counts").isNull() & (F.col("size") >= 0) if units.prints else F.col("counts").isNull())
    units_df = units_df.select("doc_id", "digest", "unit", "n_words", "size", "node")
    rel = written(spark, visits(postings(docs, units, make_keys(counts))), "visits")
    least = F.min(F.struct("doc_id", "unit", "size")).alias("first")
    nodes = units_df.where(F.col("node").isNotNull()).groupBy("node").agg(least).select("node", "first.*")
    links = written(spark, block_links(docs, units, rel, nodes), "links")
    discard(rel)
    found = components(spark, links)
    discard(links)
    return units_df, found.select(F.col("id").alias("node"), "component")
