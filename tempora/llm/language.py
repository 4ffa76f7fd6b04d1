"""Language identification by rank-order profiles of n-grams (out-of-place distance).

A language's profile is the ranking of its PROFILE most frequent n-grams (1 to 3 letters,
within words, with a mark for word ends) over all its training documents. A document is
ranked the same way over all of its n-grams, and its distance to a language is the sum over
its TOP most frequent ones of the difference of the two ranks, PROFILE where the language
lacks the n-gram. The score is 1 less the least distance as a share of the largest possible.

An n-gram is one number: three code points of 21 bits, 0 for a word's end.

Defined results: null texts and texts without a letter are `und` with score 0; without any
training row all are `und`; ties go to the language that sorts first; repeated rows are
predicted each; columns other than text are never looked at for a prediction. An empty table
gives no row. A kept column that is named like a column of the result gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.llm.common import by_blocks, only, quoted, stream, table

PROFILE, TOP = 400, 300
#: Text bytes whose n-grams are held at once, one document at least.
BLOCK = 1 << 18
#: Distinct n-grams that a training task holds before it passes its counts on.
HELD = 1 << 20
#: Languages that may be told apart; what is broadcast is bounded by it times PROFILE.
MAX_LANGUAGES = 1000

_letters: np.ndarray | None = None


def letters_of() -> np.ndarray:
    """The lower-case letter of every code point, 0 for what is no letter. Built once in a process."""
    global _letters
    if _letters is None:
        out = np.zeros(0x110000, np.int32)
        for cp in range(0x110000):
            if (c := chr(cp)).isalpha():
                out[cp] = ord(c.lower()[0])
        _letters = out
    return _letters


WORD_END, PAIR, THREE = 0, np.int64(1 << 43), np.int64(-(1 << 63))


def pieces(text: str) -> Iterator[str]:
    """The text, cut at blanks if it is long; a cut is a word's end, so the n-grams stay the same."""
    at = 0
    while at < len(text):
        to = text.find(" ", at + BLOCK)
        to = len(text) if to < 0 else to
        yield text[at:to]
        at = to


def grams(text: str) -> np.ndarray:
    """All n-grams of a piece of text; empty if it has no letter."""
    low = letters_of()[np.frombuffer(f"\n{text}\n".encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] | low[:-1]) != WORD_END  # one mark between words
    s = low[keep].astype(np.int64)
    if len(s) < 3:
        return s[:0]
    pair = s[:-1] << 21 | s[1:]
    three = pair[:-1] << 21 | s[2:]
    return np.concatenate([s[s != WORD_END], pair | PAIR, three[s[1:-1] != WORD_END] | THREE])


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums (n-grams, counts), each sorted by n-gram."""
    if len(parts) == 1:
        return parts[0]
    ids, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    return ids[first], np.add.reduceat(n[order], first) if len(first) else n


def counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids = np.sort(ids)
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    return ids[first], np.diff(np.append(first, len(ids)))


def ranked(text: str) -> np.ndarray:
    """The TOP most frequent n-grams of a document, most frequent first, ties by n-gram."""
    ids, n = merged([counted(grams(p)) for p in pieces(text)] or [counted(np.zeros(0, np.int64))])
    key = n * len(ids) + np.arange(len(ids))[::-1]
    if len(ids) > TOP:
        top = np.argpartition(key, len(ids) - TOP)[len(ids) - TOP :]
        ids, key = ids[top], key[top]
    return ids[np.argsort(-key)]


class Profiles:
    """Ranks by language over the union of all profiles' n-grams."""

    def __init__(self, ranked: dict[str, list[int]]):
        self.languages = sorted(ranked)
        self.union = np.array(sorted({g for ids in ranked.values() for g in ids}), np.int64)
        #: the last column is for n-grams that are in no profile
        self.ranks = np.full((len(self.languages), len(self.union) + 1), PROFILE, np.int32)
        for k, name in enumerate(self.languages):
            self.ranks[k, np.searchsorted(self.union, np.array(ranked[name], np.int64))] = np.arange(len(ranked[name]))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(texts))
        for at, text in enumerate(texts):
            own = ranked(text or "")
            if not len(own) or not self.languages:
                names.append("und")
                continue
            column = np.searchsorted(self.union, own)
            known = self.union[np.minimum(column, len(self.union) - 1)] == own if len(self.union) else np.zeros(len(own), bool)
            there = self.ranks[:, np.where(known, column, len(self.union))]
            apart = np.where(there < PROFILE, np.abs(there - np.arange(len(own))), PROFILE).sum(1)
            best = int(apart.argmin())
            names.append(self.languages[best])
            scores[at] = 1 - apart[best] / (len(own) * PROFILE)
        return names, scores


def profiles(docs: DataFrame) -> Profiles:
    """Counts n-grams of all training rows by language; rows are (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def sums() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                ids, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids)), pa.array(ids), pa.array(n)], ["lang", "gram", "n"])

        size = 0
        for batch in batches:
            for block in by_blocks(batch, "text", BLOCK):
                by: dict[str, list[np.ndarray]] = {}
                for text, lang in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                    by.setdefault(lang, []).extend(grams(p) for p in pieces(text))
                for lang, ids in by.items():
                    if ids:
                        held.setdefault(lang, []).append(counted(np.concatenate(ids)))
                        size += len(held[lang][-1][0])
                if size > HELD:
                    held = {lang: [merged(parts)] for lang, parts in held.items()}
                    size = sum(len(parts[0][0]) for parts in held.values())
                    if size > HELD // 2:
                        yield from sums()
                        held, size = {}, 0
        yield from sums()

    counts = docs.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # a ranking of counts: as many rows as there are n-grams in use, with partial limits before the shuffle
    first = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= PROFILE)
    out: dict[str, list[tuple[int, int]]] = {}
    for lang, gram, rank in first.select("lang", "gram", "rank").limit(MAX_LANGUAGES * PROFILE + 1).collect():
        out.setdefault(lang, []).append((rank, gram))
    if len(out) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return Profiles({lang: [g for _, g in sorted(rows)] for lang, rows in out.items()})


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def predict(docs: DataFrame, model: Profiles, keep: list[str], into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` and the prediction, under the names of `into`, of every row; `keep` holds text or not."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    taken = {n.lower() for n in into}
    keep = [c for c in keep if c.lower() not in taken]
    # the text goes first, once; `place` is where it stands in the result, if it does
    rest = [c for c in keep if c != "text"]
    place = keep.index("text") if "text" in keep else None
    kept = docs.select(*quoted(keep))
    names = [f"c{k}" for k in range(len(rest))]

    def step(block: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = shared.value.predict(block.column(0).to_pylist())
        columns = block.columns[1:]
        if place is not None:
            columns.insert(place, block.column(0))
        return pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score)], out_names)

    out_names = [f"o{k}" for k in range(len(keep))] + ["lang", "score"]
    source = docs.select(F.col("text").alias("t"), *[c.alias(n) for c, n in zip(quoted(rest), names, strict=True)])
    fields = ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in zip(out_names, kept.schema.fields, strict=False))
    out = stream(source, source.columns, step, f"{fields}{', ' if keep else ''}lang string, score double", text="t")
    return out.toDF(*keep, *into)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, profiles(training_rows(docs)), ["doc_id"])
    return found.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out"), "lang_pred", "score")
