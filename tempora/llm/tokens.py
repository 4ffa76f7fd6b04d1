"""Token counts by a compiled finite-state transducer.

The vocabulary file's tokenizer never joins text across blank, tab, line feed or carriage
return, so a text's count is the sum over its fragments between them. The transducer is a
trie over the bytes of fragments, letters folded to lower case: following a byte emits
nothing, and the transition on a separator emits the tokens of the fragment that ends there
and goes back to the root. It is deterministic, its emissions are asked of the tokenizers
library once for each fragment, and it is extended as new fragments turn up, up to NODES
states; fragments beyond it (or with bytes outside its alphabet) leave it for a dead state
and are counted by the library, so counts are exact whatever the trie holds.

Texts are cut into chunks of CHUNK bytes at any place, and all chunks are run at once, one
byte a step, in numpy. A chunk's map from the state before it to the state after it and the
tokens it emits is: the emission of its head (the bytes up to its first separator) by the
state before, plus a constant; and the state after is a constant once a separator is seen,
or once more than DEPTH bytes without one have led to the dead state. Chunks are longer than
DEPTH, so every map's state after is a constant and composing it with any map before it
gives the map itself: the scan over chunks is a shift by one. Only chunks of DEPTH bytes or
less (tests) need further rounds. From the states so found, the heads alone are run again,
all at once, and a prefix sum over the emissions gives each text's count.

Defined results: null and empty texts count 0 tokens; repeated rows are counted each; an
empty table gives no row; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import stream, table
from tempora.llm.packing import vocabulary_path

VOCABULARY, OVER = "word_bpe_49k.json", 2048
CHUNK, NODES, DEPTH = 1024, 250_000, 40
ROOT, DEAD = 0, 1

#: Symbols: 0 separator, 1 none of the others (leads to DEAD), then folded letters, marks and
#: the two-byte letters of Latin-1 by lead byte and second byte.
SEPARATORS = b" \t\n\r"
MARKS = b".,!?;:'\"()[]{}|/\\-_+=*&^%$#@~`"


def alphabet() -> tuple[np.ndarray, int]:
    out = np.ones(256, np.uint8)
    out[list(SEPARATORS)] = 0
    n = 2
    for c in range(97, 123):
        out[c] = out[c - 32] = n
        n += 1
    for c in [*MARKS, 0xC3, *range(0x80, 0xC0)]:
        out[c] = n
        n += 1
    return out, n


SYMBOL, WIDE = alphabet()


class Transducer:
    def __init__(self, tokenizer, nodes: int = NODES):
        self.tokenizer = tokenizer
        self.next = np.full((nodes, WIDE), DEAD, np.int32)
        self.next[:2, 0] = self.next[:, 0] = ROOT
        self.emit = np.full(nodes, -1, np.int32)  # tokens of the fragment that ends here; -1: not known
        self.emit[ROOT] = 0
        self.used, self.nodes = 2, nodes

    def learn(self, fragments: list[bytes]) -> list[int]:
        """Asks the library for the fragments' counts and adds transitions while there is room."""
        counts = [len(e.ids) for e in self.tokenizer.encode_batch_fast([f.decode("utf-8") for f in fragments], add_special_tokens=False)]
        for f, n in zip(fragments, counts, strict=True):
            if len(f) > DEPTH or self.used + len(f) >= self.nodes:
                continue
            symbols = SYMBOL[np.frombuffer(f, np.uint8)].tolist()
            if 1 in symbols:
                continue
            node = ROOT
            for s in symbols:
                to = int(self.next[node, s])
                if to == DEAD:
                    to = self.next[node, s] = self.used
                    self.used += 1
                node = to
            self.emit[node] = n
        return counts

    def count(self, texts: list[bytes], chunk: int = CHUNK) -> np.ndarray:
        """Tokens of each text."""
        data = b"\n".join(texts) + b"\n"
        n = -(-len(data) // chunk)
        raw = np.full(n * chunk, 10, np.uint8)
        raw[: len(data)] = np.frombuffer(data, np.uint8)
        symbols = np.ascontiguousarray(SYMBOL[raw].reshape(n, chunk).T)
        states = self.tails(symbols)
        before = self.scan(states[-1], symbols)
        self.heads(states, symbols, before)
        # the state in which each separator is met has the fragment's emission
        flat = states.T.ravel()
        ends = np.flatnonzero(symbols.T.ravel() == 0)
        last = np.where(ends > 0, flat[ends - 1], ROOT)
        begins = np.concatenate([[0], ends[:-1] + 1])
        tokens = self.emit[last].astype(np.int64)
        tokens[ends == begins] = 0
        missed = np.flatnonzero(tokens < 0)
        if len(missed):
            where: dict[bytes, list[int]] = {}
            for k, b, e in zip(missed.tolist(), begins[missed].tolist(), ends[missed].tolist(), strict=True):
                where.setdefault(data[b:e], []).append(k)
            for ks, got in zip(where.values(), self.learn(list(where)), strict=True):
                tokens[ks] = got
        sums = np.concatenate([[0], np.cumsum(tokens)])
        closing = np.cumsum([len(t) + 1 for t in texts]) - 1
        at = np.searchsorted(ends, closing, "right")
        return np.diff(sums[np.concatenate([[0], at])])

    def tails(self, symbols: np.ndarray) -> np.ndarray:
        """States after each byte of each chunk, -1 before the chunk's first separator."""
        steps, n = symbols.shape
        states = np.empty((steps, n), np.int32)
        state = np.full(n, DEAD, np.int32)
        flat = self.next.ravel()
        for i in range(steps):
            state = flat[state * WIDE + symbols[i]]
            states[i] = state
        # a head is run from DEAD, in which it stays: told apart by the separators seen
        unseen = np.logical_and.accumulate(symbols != 0, axis=0)
        states[unseen] = -1
        return states

    def scan(self, after: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """State before each chunk. A chunk without separator is longer than any path of the
        trie, so its map is the constant DEAD from every state but for chunks shorter than
        DEPTH; those are composed by running them, one round for each power of two."""
        n = len(after)
        state = after.copy()
        if len(symbols) > DEPTH:
            state[state < 0] = DEAD
        else:
            reach = 1
            while (state < 0).any() and reach <= 2 * n:
                open_ = np.flatnonzero(state < 0)
                open_ = open_[(open_ == 0) | (state[np.maximum(open_ - 1, 0)] >= 0)]
                begin = np.where(open_ == 0, ROOT, state[np.maximum(open_ - 1, 0)])
                for row in symbols:
                    begin = self.next[begin, row[open_]]
                state[open_] = begin
                reach += 1
        return np.concatenate([[ROOT], state[:-1]])

    def heads(self, states: np.ndarray, symbols: np.ndarray, before: np.ndarray) -> None:
        """Runs the heads of all chunks from the states before them."""
        live = np.arange(len(before))
        state = before
        for i in range(len(symbols)):
            live_now = states[i, live] < 0
            live, state = live[live_now], state[live_now]
            if not len(live):
                return
            state = self.next[state, symbols[i, live]]
            states[i, live] = state


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One for a process: what it has learned serves the tasks that follow."""
    if path not in _compiled:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _compiled[path] = Transducer(tokenizer)
    return _compiled[path]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    def step(block: pa.RecordBatch) -> pa.RecordBatch:
        texts = [(t or "").encode("utf-8", "replace") for t in block.column(1).to_pylist()]
        counts = transducer(vocabulary).count(texts)
        return pa.RecordBatch.from_arrays([block.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return stream(docs, ["doc_id", "text"], step, "doc_id long, n_bytes long, n_tokens long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(table(spark, sf_dir, "documents"), vocabulary_path(VOCABULARY))
    return counted.withColumn("over_limit", F.col("n_tokens") > OVER)
