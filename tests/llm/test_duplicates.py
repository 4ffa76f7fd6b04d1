"""Jaccard join, line dedup, repeated passages and components against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tempora.llm import jaccard, lines, paragraphs, setjoin
from tempora.llm.components import components


def shingle_set(text: str | None) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def grouped(n: int, linked) -> list[int]:
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                parent[find(i)] = find(j)
    return [find(i) for i in range(n)]


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = grouped(len(rows), lambda i, j: sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]))
    least = {}
    for (d, _), g in zip(rows, root, strict=True):
        least[g] = min(least.get(g, d), d)
    return sorted((d, len(s), least[g]) for (d, _), s, g in zip(rows, sets, root, strict=True))


def near_copies(n: int, seed: int):
    r = random.Random(seed)
    rows = [(k, " ".join(r.choice("ab") for _ in range(r.randint(0, 30)))) for k in range(n)]
    base = [str(k) for k in range(60)]
    for k in range(n, 2 * n):
        w = base[: r.choice([12, 20, 60])]
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice("xyz")
        rows.append((k, " ".join(w)))
    return [*rows, (3, "another text under a known id here"), (9990, None), (9991, ""), (9992, " \n\t "), (9993, "One two"), (9994, "one TWO"), (5, rows[5][1])]


def test_links_are_exact(spark, docs_of):
    rows = near_copies(150, 4)
    found = sorted(tuple(r) for r in jaccard.linked_documents(spark, docs_of(rows)).collect())
    assert found == brute_components(rows)


def test_links_are_exact_in_small_chunks(spark, docs_of, monkeypatch):
    rows = near_copies(60, 6)
    monkeypatch.setattr(setjoin, "CHUNK", 300)  # large blocks are split, and streamed past each chunk
    found = sorted(tuple(r) for r in jaccard.linked_documents(spark, docs_of(rows)).collect())
    assert found == brute_components(rows)


def test_no_documents(spark, docs_of):
    assert jaccard.linked_documents(spark, docs_of([])).collect() == []
    assert lines.marked(spark, docs_of([]), ["doc_id"]).collect() == []
    assert paragraphs.repeats(spark, docs_of([])).collect() == []


@pytest.mark.parametrize("n", range(1, 40))
def test_similar_sets_share_a_key_within_reach(n):
    r = np.random.default_rng(n)
    counts = r.integers(0, 5, 1 << 10).astype(np.uint32)
    keys = jaccard.heavy_light(counts)
    for _ in range(20):
        a = r.choice(10_000, n, replace=False).astype(np.uint64)
        b = np.concatenate([a[: max(1, n - r.integers(0, 1 + n // 6))], r.choice(np.arange(20_000, 30_000), r.integers(0, 1 + n // 6), replace=False).astype(np.uint64)])
        both = len(set(a.tolist()) & set(b.tolist()))
        if 100 * both < 75 * (len(a) + len(b) - both):
            continue
        flat = [np.sort(a), np.sort(b)]
        key, reach, owner = keys(setjoin.Sets(np.concatenate(flat), np.array([0, len(a), len(a) + len(b)])))
        mine = {int(k): int(x) for k, x, o in zip(key, reach, owner, strict=True) if o == 0}
        other = {int(k): int(x) for k, x, o in zip(key, reach, owner, strict=True) if o == 1}
        assert any(mine[k] >= len(b) and other[k] >= len(a) for k in mine.keys() & other.keys())


def test_the_boundary_follows_cost():
    rare, common = np.ones(1 << 10, np.uint32), np.zeros(1 << 10, np.uint32)
    common[:4] = 100_000
    assert jaccard.boundary(rare) < jaccard.boundary(common)


def test_components_of_chains_and_stars(spark):
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(40)] + [(1000, k) for k in range(1001, 1100)] + [(2000, 2000), (2001, 2002), (2002, 2001)]
    r.shuffle(edges)
    found = {x.id: x.component for x in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[k] == 0 for k in range(41)) and all(found[k] == 1000 for k in range(1000, 1100)) and found[2002] == 2001


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def changed(r: random.Random, text: str) -> str:
    x = list(text)
    for _ in range(r.randint(0, 4)):
        p, kind = r.randrange(len(x)), r.random()
        if kind < 0.4:
            x[p] = r.choice("abcd")
        elif kind < 0.7:
            del x[p]
        else:
            x.insert(p, r.choice("abcd"))
    return "".join(x)


def near_lines(a: str, b: str) -> bool:
    bound = min(lines.EDITS, min(len(a), len(b)) // lines.TENTH)
    return a == b or abs(len(a) - len(b)) <= bound and edit_distance(a, b) <= bound


@pytest.mark.parametrize("broadcast_rows", [lines.BROADCAST_ROWS, 0])
def test_near_lines_go(spark, docs_of, monkeypatch, broadcast_rows):
    monkeypatch.setattr(lines, "BROADCAST_ROWS", broadcast_rows)
    r = random.Random(3)
    base = ["".join(r.choice("abcé ") for _ in range(r.randint(3, 26))) for _ in range(40)]
    rows = [(k, "\n".join(changed(r, r.choice(base)) for _ in range(r.randint(0, 6)))) for k in range(200)] + [(401, None), (402, ""), (403, "short\nshort\n\n"), (None, "short\nnew")]
    known = sorted({x for _, t in rows if t for x in t.split("\n") if x})
    root = grouped(len(known), lambda i, j: near_lines(known[i], known[j]))
    group = dict(zip(known, root, strict=True))
    seen, want = set(), {}
    for doc_id, text in rows:
        kept = []
        for x in (text or "").split("\n"):
            if not x or group[x] not in seen:
                kept.append(x)
            seen.add(group.get(x, x))
        want[doc_id] = None if text is None else "\n".join(kept)
    df = docs_of(rows).selectExpr("doc_id", "text", "'k' as key", "length(text) as n_chars", "1 as class", "2 as places", "3 as gone", "4 as `own.`")
    found = lines.without_repeats(spark, df)
    assert found.columns == df.columns
    got = {x.doc_id: (x.text, x.n_chars) for x in found.collect()}
    assert got == {k: (t, None if t is None else len(t)) for k, t in want.items()}
    assert {x.doc_id: x.places for x in found.collect()} == dict.fromkeys(want, 2)


def test_rows_that_share_a_doc_id_lose_only_their_own_lines(spark, docs_of):
    rows = [(1, "a line that stands twice\nalone in one"), (5, "a line that stands twice\nalone in five"), (5, "unique text\nthat stays"), (None, "alone in one"), (None, "of none")]
    got = sorted(map(tuple, lines.without_repeats(spark, docs_of(rows)).collect()), key=str)
    assert got == sorted([(1, rows[0][1]), (5, "alone in five"), (5, rows[2][1]), (None, ""), (None, "of none")], key=str)


def test_lines_of_any_length_and_no_rows(spark, docs_of):
    long_ = "".join(random.Random(k).choice("abc ") for k in range(30_000))
    rows = [(1, long_), (2, long_[:17] + "zz" + long_[17:]), (3, long_[:17] + "zzz" + long_[17:]), (4, "\n".join(["x"] * 5000))]
    got = {x.doc_id: x.text for x in lines.without_repeats(spark, docs_of(rows)).collect()}
    # the third is one edit from the second
    assert got == {1: long_, 2: "", 3: "", 4: "x"}
    assert lines.without_repeats(spark, docs_of([])).collect() == []


@pytest.mark.parametrize("most", [1, 2, 3])
def test_bit_parallel_distances_are_exact(spark, most):
    from pyspark.sql import functions as F

    r = random.Random(most)
    pairs = [(a, changed(r, a)) for a in ("".join(r.choice("abé😀") for _ in range(r.randint(5, 14))) for _ in range(300))]
    pairs = [(a, b) for a, b in pairs if abs(len(a) - len(b)) <= most and a and b]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", lines.within("a", "b", most).alias("d"), F.levenshtein("a", "b").alias("l"))
    for x in df.collect():
        want = edit_distance(x.a, x.b)
        assert x.l == want and x.d == (want if want <= most else None)


def test_words_tell_at_most_three_bits_an_edit(spark):
    from pyspark.sql import functions as F

    r = random.Random(4)
    pairs = [(a, changed(r, a)) for a in (" ".join("".join(r.choice("abcd") for _ in range(r.randint(0, 3))) for _ in range(r.randint(1, 30))) + "a" for _ in range(300))]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.bit_count(lines.word_parities("a").bitwiseXOR(lines.word_parities("b"))).alias("n"))
    assert all(x.n <= 3 * edit_distance(x.a, x.b) for x in df.collect())


def test_the_pipeline_drops_equal_short_lines(spark, docs_of):
    import corpus_pipeline

    rows = [(1, "Les.\n\na line of more than twenty letters"), (2, "other\nLes.\n\nLes!"), (3, "And ornd.\nthe end\nAnd ornd."), (4, "Les."), (5, ""), (6, None)]
    kept = {x.doc_id: x.text for x in corpus_pipeline.drop_repeated_lines(spark, docs_of(rows), "").collect()}
    assert kept == {1: rows[0][1], 2: "other\n\nLes!", 3: "And ornd.\nthe end", 5: "", 6: None}


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_segments_of_near_lines_meet(edits):
    r = random.Random(edits)
    for _ in range(300):
        a = "".join(r.choice("ab") for _ in range(r.randint(20, 40)))
        b = list(a)
        for _ in range(r.randint(1, edits)):
            p, kind = r.randrange(len(b)), r.randrange(3)
            if kind == 0:
                b[p] = r.choice("abc")
            elif kind == 1:
                del b[p]
            else:
                b.insert(p, r.choice("abc"))
        short, long_ = sorted((a, "".join(b)), key=len)

        def segment(text: str, n: int, i: int, offset: int) -> str | None:
            base, longer = divmod(n, edits + 1)
            short_ones = edits + 1 - longer
            at = (i - 1) * base + max(0, i - 1 - short_ones) + offset
            size = base + (i - 1 >= short_ones)
            return text[at : at + size] if at >= 0 and at + size <= len(text) else None

        index = {i: segment(short, len(short), i, 0) for i in range(1, edits + 2)}
        probes = [(i, segment(long_, len(short), i, o)) for less, i, o, _ in lines.segment_keys(edits) if less == len(long_) - len(short)]
        assert any(p is not None and index[i] == p for i, p in probes)


def test_passages_that_repeat(spark, docs_of):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    line = lambda n: " ".join(word() for _ in range(n))
    passage, long_ = line(60), ". ".join(line(12) for _ in range(12)) + "."
    near = passage.split()
    near[30] = "changed"
    rows = [(k, "\n".join([line(40), line(25), line(5)])) for k in range(20)]
    rows += [(100 + k, "\n".join([line(30), passage])) for k in range(5)] + [(200, line(30) + "\n" + " ".join(near))]
    rows += [(300 + k, line(30) + ". " + long_ + " " + line(20)) for k in range(3)] + [(400, None), (401, "")]
    found = paragraphs.repeats(spark, docs_of(rows)).collect()
    assert {x.doc_id for x in found} == {100, 101, 102, 103, 104, 200, 300, 301, 302}
    assert {x.class_doc_id for x in found if x.doc_id <= 200} == {100} and sum(not x.removed for x in found if x.doc_id <= 200) == 1
    df = docs_of(rows).selectExpr("doc_id", "text", "'s' as node")
    kept = {x.doc_id: x.text for x in paragraphs.without_repeats(spark, df).collect()}
    assert passage in kept[100] and all(passage not in kept[100 + k] for k in range(1, 5)) and kept[0] == rows[0][1] and kept[400] is None
    assert "changed" not in kept[200] and len(kept[301]) < len(rows[27][1])


def test_passages_that_keep_to_no_line(spark, docs_of):
    """51 words spliced into lines, over short lines, and without any sentence mark."""
    r = random.Random(18)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]
    def broken(words, n):
        return "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))

    mid, short, long_ = some(51), some(51), some(51)
    rows = [(k, " ".join(some(11 + k) + mid + some(12))) for k in range(3)]
    rows += [(10, broken(some(7) + short + some(9), 6)), (11, broken(some(3) + short + some(30), 8)), (12, " ".join(some(40) + short + some(40)))]
    rows += [(20 + k, " ".join(some(150) + long_ + some(90))) for k in range(2)]
    rows += [(30, broken(some(200), 9)), (31, " ".join(["same"] * 200)), (32, " ".join(some(70) + mid[:30] + some(40)))]
    found = paragraphs.repeats(spark, docs_of(rows)).collect()
    assert {x.doc_id for x in found} - {31} == {0, 1, 2, 10, 11, 12, 20, 21}
    assert {x.doc_id for x in found if x.removed} - {31} == {1, 2, 11, 12, 21}
    kept = {x.doc_id: (x.text or "").split() for x in paragraphs.without_repeats(spark, docs_of(rows)).collect()}
    for d, text in rows:
        lost = len(text.split()) - len(kept[d])
        assert lost == 0 if d in (0, 10, 20, 30, 32) else d == 31 or 40 <= lost <= 51
    assert set(kept[1]) >= set(rows[1][1].split()) - set(mid)


def test_bands_reach_their_recall():
    bands, per = paragraphs.tuned()
    assert 1 - (1 - 0.75**per) ** bands >= paragraphs.RECALL


def test_letter_counts_never_exceed_twice_the_edits(spark):
    """Counts of any size: the remainders fill all bits of the number, the sign's too."""
    from pyspark.sql import functions as F

    r = random.Random(12)
    pairs = []
    for k in range(200):
        a = "".join(r.choice(lines.LETTERS) * r.randint(1, 20) for _ in range(r.randint(1, 40)))
        pairs.append((a, changed(r, a), "".join(r.choice(lines.LETTERS) for _ in range(k + 1))))
    df = spark.createDataFrame([*pairs, ("p" * 15 + "m" * 8, "", "p" * 8)], "a string, b string, c string")
    apart = lambda x, y: lines.counts_apart(lines.letter_counts(F.col(x)), lines.letter_counts(F.col(y)))
    for row in df.select("a", "b", "c", apart("a", "b").alias("near"), apart("a", "c").alias("far"), apart("a", "a").alias("same")).collect():
        assert row.same == 0 <= row.far
        assert row.b == "" or row.near <= 2 * 4  # `changed` makes four edits at most
        exact = sum(min(d, 16 - d) for d in ((row.a.count(x) - row.c.count(x)) % 16 for x in lines.LETTERS))
        assert row.far == exact


def test_passages_of_rows_that_share_a_doc_id(spark, docs_of):
    r = random.Random(21)
    text = lambda n: " ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(n))
    twice, unique, other = text(70), text(70), text(30)
    rows = [(1, twice), (5, twice), (5, unique), (None, twice + "\n" + other), (7, unique + " " + other + "\n" + twice)]
    df = docs_of(rows).selectExpr("doc_id", "text", "1 as own", "2 as gone", "3 as `a.b`")
    found = paragraphs.without_repeats(spark, df)
    assert found.columns == df.columns
    # the row without a doc_id comes first
    assert sorted((x.doc_id or 0, x.text.strip()) for x in found.collect())[:4] == sorted([(0, rows[3][1]), (1, ""), (5, ""), (5, unique)])


def test_a_large_group_of_copies_and_near_copies(spark, docs_of):
    r = random.Random(22)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(base)) for k in range(5000)]
    for k in range(5000, 8000):
        w = list(base)
        w[r.randrange(60)] = f"x{k}"
        rows.append((k, " ".join(w)))
    got = jaccard.linked_documents(spark, docs_of(rows).repartition(8)).collect()
    assert len(got) == len(rows) and {x.component_id for x in got} == {0}
