"""Repeated passages: near copies of paragraphs, then word runs that repeat in what they leave.

A paragraph is a line; lines of more than LONG words are cut at sentence ends, at places that
depend on the words before the cut alone, so that a passage is cut alike wherever it stands.
A passage has PASSAGE words at least: paragraphs of fewer are none by themselves (repeated
lines are line dedup's), but their words take part in the runs below. Two paragraphs are near copies if
their sets of 5-word shingles have a Jaccard similarity of 0.75 or more; the bands are tuned
so that such a pair collides with probability RECALL at least. Colliding paragraphs are
verified exactly, the first paragraph of each component (by doc_id, then place) stays, and
the others are to be removed.

Passages need not keep to lines. Over the word stream of each text, newlines and short lines
included, runs of PASSAGE words are hashed, and of every AHEAD runs that begin one after
another the least hash is a fingerprint. So any LEAST_RUN words that occur at two places hold a
fingerprint that both have, wherever the passage begins and however lines are broken. Of the
fingerprints that lie in no removed paragraph, those that occur twice are rows too: the first
place stays, the words of the others are to be removed. A run of LEAST_RUN words or more is found
for certain, one of PASSAGE words or more may be found; up to AHEAD - 1 words at either end of
a run are in no fingerprint and stay.

Their paragraph is -1 less the number of their first word in the text.

Defined results: null and empty texts have no paragraphs; equal paragraphs of one document
are repeats too; rows that are equal in doc_id and text are one, which keeps its first passages
in each; an empty table gives no row; columns other than doc_id and text are carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import by_blocks, fresh, quoted, table, written
from tempora.llm.setjoin import PERCENT, Keys, Parts, Sets, Units, _hashes, classes_of, described, mixed

PASSAGE, AHEAD = 40, 12
LONG, RECALL = 80, 0.999
LEAST_RUN = PASSAGE + AHEAD - 1
SENTENCE_END = re.compile(rb"[.!?](?=[ \t\r\x0b\x0c]|\Z)")
NOT_BLANK = re.compile(rb"[^ \t\r\x0b\x0c]+")
#: Dissimilar paragraphs (a quarter of the union in common) that may collide, as a share.
LOOSE, LOOSE_AT = 0.5, 0.25


def tuned(threshold: float = PERCENT / 100, recall: float = RECALL) -> tuple[int, int]:
    """(bands, rows): the fewest hashes in all that reach the recall and keep loose collisions down."""
    best = None
    for rows in range(1, 9):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        loose = 1 - (1 - LOOSE_AT**rows) ** bands
        if loose <= LOOSE and (best is None or bands < best[0]):
            best = bands, rows
    assert best
    return best


def spans(text: str | None) -> list[tuple[int, int, list[bytes]]]:
    """(begin, end, words) of every paragraph, in UTF-8 bytes of the text; together they are all lines."""
    data = (text or "").encode("utf-8", "replace")
    out, at = [], 0
    for line in data.split(b"\n"):
        words = line.lower().split()
        if len(words) <= LONG:
            out.append((at, at + len(line), words))
        else:
            begin = last = k = done = 0
            for m in SENTENCE_END.finditer(line):
                k, done = k + len(line[done : m.end()].split()), m.end()
                if k > 1 and (_hashes[words[k - 1]] ^ _hashes[words[k - 2]]) % 3 == 0:
                    out.append((at + begin, at + done, words[last:k]))
                    begin, last = done, k
            if last < len(words):
                out.append((at + begin, at + len(line), words[last:]))
            elif begin < len(line):  # blanks after the last cut
                out.append((at + begin, at + len(line), []))
        at += len(line) + 1
    return out


def numbered(text: str | None) -> Parts:
    return [(k, words) for k, (_, _, words) in enumerate(spans(text))]


def fingerprints(texts: list[Parts], h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first word, key, first and last unit of the least of every AHEAD runs of PASSAGE words.

    Of equal runs of one text that overlap, as in "a a a ...", the first is kept.
    """
    none = np.zeros(0, np.int64)
    lengths = [len(words) for text in texts for _, words in text]
    n = len(h)
    windows = n - LEAST_RUN + 1
    if windows <= 0:
        return none, none, none.astype(np.uint64), none, none
    unit = np.repeat(np.array([k for text in texts for k, _ in text], np.int64), lengths)
    sizes = np.array([sum(len(words) for _, words in text) for text in texts], np.int64)
    owner, starts = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    factor = 0x9E3779B97F4A7C15
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, factor, np.uint64)]), dtype=np.uint64)
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, pow(factor, -1, 1 << 64), np.uint64)]), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h) * up, dtype=np.uint64)])
    key = mixed((sums[PASSAGE:] - sums[:-PASSAGE]) * down[: n - PASSAGE + 1])
    inside = owner[:windows] == owner[LEAST_RUN - 1 :]
    least = key[:windows].copy()
    for k in range(1, AHEAD):
        np.minimum(least, key[k : k + windows], out=least)
    chosen = np.zeros(len(key), bool)
    for k in range(AHEAD):
        chosen[k : k + windows] |= inside & (key[k : k + windows] == least)
    at = np.flatnonzero(chosen)
    at = at[np.lexsort((at, key[at], owner[at]))]
    again = np.flatnonzero((key[at[1:]] == key[at[:-1]]) & (owner[at[1:]] == owner[at[:-1]])) + 1
    kept = at.copy()  # the place that each is kept for
    for k in again.tolist():
        if at[k] - kept[k - 1] < PASSAGE:
            kept[k] = kept[k - 1]
    at = at[kept == at]
    return owner[at], at - starts[owner[at]], key[at], unit[at], unit[at + PASSAGE - 1]


def banded(_: np.ndarray | None) -> Keys:
    bands, rows = tuned()
    seeds = np.random.default_rng(20).integers(1, 2**63, (bands, rows), dtype=np.uint64)

    def keys(sets: Sets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        full = np.flatnonzero(sets.sizes)
        out = []
        for band in range(bands if len(full) else 0):
            key = np.full(len(full), band + 1, np.uint64)
            for row in range(rows):
                key = mixed(key + mixed(np.minimum.reduceat(mixed(sets.flat ^ seeds[band, row]), sets.starts[full])))
            out.append(key)
        reach = sets.sizes[full] * 4 // 3
        return np.concatenate([np.zeros(0, np.uint64), *out]), np.tile(reach, len(out)), np.tile(full, len(out))

    return keys


def repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Every paragraph that has near copies: doc_id, digest (of the row's text), paragraph, n_words, the class's first (class_doc_id, class_paragraph), and whether it goes.

    So too the repeated passages outside removed paragraphs, with paragraph below 0.
    """
    kinds = Units(numbered, PASSAGE, fingerprints)
    described_ = written(spark, described(docs, kinds, False), "units")
    units, classes = classes_of(spark, docs, described_, kinds, banded, sketch=False)
    rows = units.join(classes, "node", "left").withColumn("class", F.coalesce("component", "node"))
    first = rows.groupBy("class").agg(F.min(F.struct("doc_id", "unit")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    # written, so that the join has two plain exchanges, of which the planner can split a hot class
    whole = rows.join(written(spark, first, "first"), "class").select(
        "doc_id",
        "digest",
        F.col("unit").alias("paragraph"),
        "n_words",
        F.col("first.doc_id").alias("class_doc_id"),
        F.col("first.unit").alias("class_paragraph"),
        (F.struct("doc_id", "unit") != F.col("first")).alias("removed"),
    )
    whole = written(spark, whole, "paragraphs")
    return whole.unionByName(repeated_passages(spark, described_.where("size < 0"), whole))


def repeated_passages(spark: SparkSession, prints: DataFrame, whole: DataFrame) -> DataFrame:
    """Rows like those of `whole`, the repeated paragraphs, for fingerprints that occur twice outside removed ones."""
    prints = prints.select("doc_id", "digest", F.col("unit").alias("at"), F.col("node").alias("key"), "first", "last")
    twice = written(spark, prints.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1").select("key"), "twice")
    gone = whole.where("removed").groupBy("doc_id", "digest").agg(F.collect_set("paragraph").alias("gone")).toDF("id", "of", "gone")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of"))
    left = prints.join(twice, "key").join(gone, same, "left").where("gone is null or not exists(gone, g -> g between first and last)")
    left = written(spark, left.select("key", "doc_id", "digest", "at"), "passages")
    first = left.groupBy("key").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    return left.join(written(spark, first, "first"), "key").select(
        "doc_id",
        "digest",
        (-1 - F.col("at")).alias("paragraph"),
        F.lit(PASSAGE).alias("n_words"),
        F.col("first.doc_id").alias("class_doc_id"),
        (-1 - F.col("first.at")).alias("class_paragraph"),
        (F.struct("doc_id", "at") != F.col("first")).alias("removed"),
    )


def without_words(piece: bytes, numbers: set[int]) -> bytes:
    """A paragraph without some of its words and the blanks after each."""
    if not numbers:
        return piece
    begins = [m.start() for m in NOT_BLANK.finditer(piece)]
    ends = [*begins[1:], len(piece)]
    return piece[: begins[0]] + b"".join(piece[a:b] for k, (a, b) in enumerate(zip(begins, ends, strict=True)) if k not in numbers)


def without_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs, with the text of removed paragraphs and passages gone; all columns stay, n_chars (if there) follows the text.

    Rows with equal doc_id are told apart by their texts.
    """
    own, of, numbers = (fresh(docs.columns, n) for n in ("own", "of", "gone"))
    gone = repeats(spark, docs).where("removed").groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set("paragraph"))).toDF(own, of, numbers)
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(of))
    joined = docs.join(gone, same, "left").select(*quoted([*docs.columns, numbers]))
    names, at = docs.columns, docs.columns.index("text")
    places = [f"c{k}" for k in range(len(names) + 1)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in by_blocks(batch, places[at]):
                texts = []
                for text, numbers in zip(block.column(at).to_pylist(), block.column(len(names)).to_pylist(), strict=True):
                    if numbers and text is not None:
                        data, drop = text.encode("utf-8", "replace"), set(numbers)
                        cut_words = {-1 - k + i for k in drop if k < 0 for i in range(PASSAGE)}
                        pieces, end, n = [], 0, 0
                        for k, (a, b, words) in enumerate(spans(text)):
                            if k not in drop:
                                between = data[end:a] if pieces else b""
                                pieces.append(between + without_words(data[a:b], {i - n for i in range(n, n + len(words)) if i in cut_words}))
                            end, n = b, n + len(words)
                        text = b"".join(pieces).decode("utf-8", "replace")
                    texts.append(text)
                columns = [pa.array(texts, pa.string()) if i == at else block.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(columns, places[:-1])

    joined = joined.toDF(*places)
    out = joined.mapInArrow(cut, joined.drop(places[-1]).schema).toDF(*names)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark, table(spark, sf_dir, "documents")).drop("digest")
