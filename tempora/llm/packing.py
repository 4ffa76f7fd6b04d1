"""Best-fit decreasing packing of token sequences into windows of fixed capacity.

A document is its ids by a byte-level BPE vocabulary file, followed by one end id. Documents
of more than a window are first cut into full windows; the pieces left are taken longest
first, and each goes to the open window with the least room that still holds it, which a
segment tree indexed by remaining capacity finds in log(capacity) steps.

Every input partition packs its own pieces, in blocks of BLOCK pieces, so no shuffle is
needed and a worker's memory is bounded; each block leaves a handful of windows unfilled.

Defined results: null and empty texts are one piece of the end id alone; repeated rows are
packed each; an empty table gives no piece; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tempora.llm.common import by_blocks, cached, only, table

WINDOW, END_ID, BLOCK = 2048, 1, 1 << 18
VOCABULARY = "byte_bpe_50k.json"
#: Fragments of text whose ids a worker keeps, of either kind; others are encoded again where they occur.
KEPT = 200_000

#: White space up to the next other character, and what follows it up to white space. The
#: vocabulary's own splitting never joins a character to the white space after it, and looks
#: no further back than the start of a run of white space, so fragments can be encoded alone.
FRAGMENT = re.compile(r"[ \n\t]*[^ \n\t]+|[ \n\t]+")
#: Texts with these are cut by FRAGMENT; others at single spaces, which is faster.
UNEVEN = ("  ", "\n ", " \n", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200C)))
#: Fragments that both libraries split alike, whatever their tables of characters.
PLAIN = re.compile(r"[\n -;=-~\xc0-\xd6\xd8-\xf6\xf8-\xff]*")


class Kept(dict):
    """ids of fragments as bytes; the prefix stands before each. Holds KEPT fragments at most."""

    def __init__(self, prefix: str, encode: Callable[[str], bytes]):
        self.prefix, self.encode = prefix, encode

    def __missing__(self, fragment: str) -> bytes:
        ids = self.encode(self.prefix + fragment)
        if len(self) < KEPT and len(fragment) <= 24:
            self[fragment] = ids
        return ids


class Encoder:
    """ids of whole texts as little-endian unsigned 32-bit bytes, as the tokenizers library gives them.

    Plain fragments go through a byte-pair merger over the same vocabulary, read from the
    same file; all others through the tokenizers library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t["content"] for t in held["added_tokens"]]
        self.raw = {i: i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size() + 1)}
        # the file writes each byte as one printable character
        letters = {chr(c): c for c in [*range(33, 127), *range(161, 173), *range(174, 256)]}
        letters |= {chr(256 + k): c for k, c in enumerate(c for c in range(256) if chr(c) not in letters)}
        assert set(letters) == set(ByteLevel.alphabet())
        ranks = {bytes(letters[c] for c in token): i for token, i in held["model"]["vocab"].items() if token not in self.special}
        split = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.merger = tiktoken.Encoding("fragments", pat_str=split, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.after_space, self.alone = cached(Kept(" ", self.fragment)), cached(Kept("", self.fragment))

    def fragment(self, text: str) -> bytes:
        if PLAIN.fullmatch(text):
            ids = self.merger(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join([self.raw[i] for i in ids])

    def ids(self, text: str) -> bytes:
        if any(u in text for u in UNEVEN):
            return b"".join(map(self.alone.__getitem__, FRAGMENT.findall(text)))
        first, *rest = text.split(" ")
        return self.alone[first] + b"".join(map(self.after_space.__getitem__, rest)) if text else b""


class RoomTree:
    """Open windows by their remaining room; finds the least room that is at least a length."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, window: int, room: int) -> None:
        self.open[room].append(window)
        self._change(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(window, its room), removed; None if no window has room."""
        node = self.leaves + length
        if not self.count[node]:
            # up to the first ancestor whose right sibling holds a window, then down its left edge
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._change(room, -1)
        return self.open[room].pop(), room

    def _change(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node >>= 1


def best_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(window, offset) of each length: windows are numbered from 0 and filled without gaps."""
    out: list[tuple[int, int]] = [(-1, -1)] * len(lengths)
    tree, windows = RoomTree(capacity), 0
    for k in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[k]
        found = tree.take(n) if n < capacity else None
        if found is None:
            found = windows, capacity
            windows += 1
        window, room = found
        out[k] = window, capacity - room
        if room > n:
            tree.add(window, room - n)
    return out


FIELDS = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}

_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for a process: workers are used again, and its fragments with them."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW) -> DataFrame:
    """One row for each piece of each document, with its place in the packed sequences.

    sequence_id is the number of the input partition times 2^32 plus a number within it.
    """
    names = list(FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(vocabulary)
        only(code.after_space, code.alone)
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 32
        held: list[tuple[int | None, int, int, int, int]] = []

        def placed() -> pa.RecordBatch:
            nonlocal base
            places = best_fit([p[2] for p in held], window)
            columns = [[p[i] for p in held] for i in range(5)] + [[base + w for w, _ in places], [o for _, o in places]]
            base += 1 + max(w for w, _ in places)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, FIELDS.values(), strict=True)], names)

        for batch in batches:
            for block in by_blocks(batch, "text"):
                for doc_id, text in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                    ids = code.ids(text or "") + END_ID.to_bytes(4, "little")
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        part = ids[4 * start : 4 * (start + window)]
                        held.append((doc_id, start, len(part) // 4, zlib.crc32(part), total))
                if len(held) >= BLOCK:
                    yield placed()
                    held = []
        if held:
            yield placed()

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path())
