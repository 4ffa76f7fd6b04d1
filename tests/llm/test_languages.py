"""Language identification against a plain form of rank-order profiles."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import pytest

from tempora.llm import language


def plain_grams(text: str) -> Counter:
    """N-grams as strings, with a space for a word's end."""
    out: Counter = Counter()
    words, word = [], ""
    for c in text + "\n":
        if c.isalpha():
            word += c.lower()[0]
        elif word:
            words.append(word)
            word = ""
    for w in words:
        out.update(w)
        marked = f" {w} "
        out.update(marked[i : i + 3] for i in range(len(w)))
        out.update(marked[i : i + 2] for i in range(1, len(w)))
    # the mark before a word is the one after the word before it
    out.update(f" {w[0]}" for w in words)
    out.update(f"{w[-1]} " for w in words)
    return out


def number(gram: str) -> int:
    n = 0
    for c in gram:
        n = n << 21 | (0 if c == " " else ord(c))
    return n | (1 << 43 if len(gram) == 2 else 0) - (1 << 63 if len(gram) == 3 else 0)


def first(counts: Counter, n: int) -> list[str]:
    return sorted(counts, key=lambda g: (-counts[g], number(g)))[:n]


def plain_prediction(text: str | None, ranked: dict[str, list[str]]) -> tuple[str, float]:
    own = first(plain_grams(text or ""), language.TOP)
    if not own or not ranked:
        return "und", 0.0
    far = {}
    for lang, grams in ranked.items():
        at = {g: k for k, g in enumerate(grams)}
        far[lang] = sum(abs(at[g] - k) if g in at else language.PROFILE for k, g in enumerate(own))
    best = min(sorted(far), key=far.__getitem__)
    return best, 1 - far[best] / (len(own) * language.PROFILE)


SCRIPTS = {"aa": "kamotilu", "bb": "schéüöñ", "cc": "абвгдежз", "dd": "漢字仮名交"}


def rows(n: int, seed: int) -> list[tuple[int, str | None, str | None]]:
    r = random.Random(seed)
    out: list[tuple[int, str | None, str | None]] = []
    for k in range(n):
        lang = r.choice(list(SCRIPTS))
        letters = SCRIPTS[lang] + ("xyz" if r.random() < 0.3 else "")
        out.append((k, r.choice(["", " ", "1-"]) + r.choice([" ", "\n", ", "]).join("".join(r.choices(letters, k=r.randint(1, 7))) for _ in range(r.choice([1, 3, 40, 400]))), lang))
    return [*out, (n, None, "aa"), (n + 1, "123 !!", None), (n + 2, "", "bb"), (n + 3, "xq\nİ ſ ﬃ", None), (0, out[0][1], None), (0, "ka ka", "aa")]


@pytest.mark.parametrize("block", [language.BLOCK, 64])
def test_predictions_are_those_of_the_plain_form(spark, monkeypatch, block):
    monkeypatch.setattr(language, "BLOCK", block)
    data = rows(80, 3)
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    model = language.profiles(language.training_rows(df))
    counts: dict[str, Counter] = {}
    for k, text, lang in data:
        if lang and text is not None and zlib.crc32(str(k).encode()) % 4 != 2:
            counts.setdefault(lang, Counter()).update(plain_grams(text))
    want = {lang: first(c, language.PROFILE) for lang, c in counts.items() if c}
    got = language.predict(df, model, ["doc_id", "text"]).collect()
    assert len(got) == len(data)
    for r in got:
        assert (r.lang_pred, pytest.approx(r.score)) == plain_prediction(r.text, want)
    local = model.predict([t for _, t, _ in data])
    assert [(a, pytest.approx(b)) for a, b in zip(*local, strict=True)] == [plain_prediction(t, want) for _, t, _ in data]


def test_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "ka mo", "aa", "kept", 0.5, 7)], "doc_id long, text string, lang string, lang_pred string, score double, `a.b` int")
    model = language.profiles(docs)
    found = language.predict(docs, model, docs.columns)
    assert found.columns == ["doc_id", "text", "lang", "a.b", "lang_pred", "score"]
    assert found.first()[:5] == (1, "ka mo", "aa", 7, "aa")
    free = language.predict(docs, model, docs.columns, into=("p", "s")).first()
    assert (free["lang_pred"], free["score"], free["p"]) == ("kept", 0.5, "aa")
    none = docs.where("doc_id > 1")
    assert language.profiles(none).languages == [] and language.predict(none, language.profiles(none), ["doc_id"]).collect() == []
    assert [tuple(r) for r in language.predict(docs, language.profiles(none), ["doc_id"]).collect()] == [(1, "und", 0.0)]


def test_ties_go_to_the_first_language(spark):
    same = spark.createDataFrame([(1, "ka mo", "zz"), (3, "ka mo", "bb")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.predict(same, language.profiles(same), ["doc_id"]).collect()] == ["bb", "bb"]


def test_a_very_long_text_is_counted_piece_by_piece(monkeypatch):
    text = " ".join("kamo"[: 1 + k % 4] for k in range(5000))
    whole = language.ranked(text)
    monkeypatch.setattr(language, "BLOCK", 100)
    assert whole.tolist() == language.ranked(text).tolist()
