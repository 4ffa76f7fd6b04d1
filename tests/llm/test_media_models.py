"""Media round trips and sniffing; language and quality models on small corpora."""

from __future__ import annotations

import gzip
import hashlib
import io
import random
import struct
import zipfile
import zlib

import pytest

from tempora.llm import language, media, quality


def png() -> bytes:
    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\7")) + chunk(b"IEND", b"")


def zipped() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


FILES = {
    "image/png": png(),
    "application/gzip": gzip.compress(b"abc" * 50),
    "application/zip": zipped(),
    "image/gif": b"GIF89a\1\0\1\0\0\0\0,\0\0\0\0\1\0\1\0\0\2\2D\1\0;",
    "image/jpeg": b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\3x1234\xff\xd9",
    "image/bmp": b"BM" + struct.pack("<IIIIiiHHIIIIII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0",
    "application/pdf": b"%PDF-1.4\nstartxref\n0\n%%EOF",
    "audio/ogg": b"OggS\0\4" + b"\0" * 20 + b"\1\3abc",
    "audio/wav": media.store(b"12345"),
}


@pytest.mark.parametrize("kind", FILES)
def test_types_are_confirmed_carved_and_damage_is_seen(kind):
    data = FILES[kind]
    assert media.true_type(data)[0] == kind
    inside = [f for f in media.sniff(b"some text " + data + b" more") if f.kind == kind]
    assert [(f.offset, f.length) for f in inside] == [(10, len(data))]
    assert media.true_type(data[: len(data) // 2])[0] == media.UNKNOWN


def test_payloads_come_back(docs_of):
    rows = [(1, "text"), (2, None), (3, "x" * 576), (4, "é" * 1000), (1, "text"), (5, "see BM RIFF GIF8 %PDF- here")]
    found = media.digest(media.media_column(docs_of(rows))).collect()
    for (doc_id, text), r in zip(rows, found, strict=True):
        data = (text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_sha256 == hashlib.sha256(media.store(payload)).hexdigest() and "type=audio/wav" in r.feature
    assert found[0][1:] == found[4][1:]


def test_media_that_are_null_or_damaged(spark):
    schema = "doc_id long, n_bytes long, declared string, media binary, n_tokens long"
    rows = [(1, 0, "image/png", None, 1), (2, 5, None, bytearray(media.store(b"12345")[:30]), 2), (3, 5, "audio/wav", bytearray(media.store(b"12345")), 3)]
    found = {r.doc_id: r for r in media.digest(spark.createDataFrame(rows, schema)).collect()}
    assert [found[k].payload_sha256 for k in (1, 2)] == [None, None] and "type=application/octet-stream" in found[1].feature + found[2].feature
    assert found[1].media_bytes == 0 and found[2].media_bytes == 30 and found[3].payload_bytes == 5
    assert media.digest(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("mark", [b"PK\x03\x04", b"%PDF-", b"\x1f\x8b\x08\0\0\0\0\0\0\0", b"RIFF", b"BM", b"\xff\xd8\xff", b"GIF89a"])
def test_many_marks_take_time_in_proportion(mark):
    import time

    begin = time.perf_counter()
    assert media.sniff(mark * 100_000) == []
    assert time.perf_counter() - begin < 20


def test_several_archives_in_one_blob():
    data = b"PK\x03\x04 no" + zipped() + b"between" + zipped() + FILES["application/pdf"] * 2
    assert [(f.kind, f.length) for f in media.sniff(data)] == [("application/zip", len(zipped()))] * 2 + [("application/pdf", len(FILES["application/pdf"]))] * 2


def test_carving_a_column(spark):
    rows = spark.createDataFrame([(1, bytearray(media.store(b"x" * 100 + png() + b"y"))), (2, None)], "doc_id long, media binary")
    one, two = media.carve(rows).collect()
    assert one.corrected == "audio/wav" and [bytes(c["bytes"]) for c in one.carved if c["kind"] == "image/png"] == [png()]
    assert two.corrected == media.UNKNOWN and two.carved == []


def corpus(n: int, seed: int) -> list[tuple[int, str, str]]:
    r = random.Random(seed)
    parts = {"aa": ["ka", "mo", "ti", "lu"], "bb": ["sch", "ein", "ver", "ung"], "cc": ["é", "eau", "oi", "ou"]}
    return [(k, " ".join("".join(r.choices(parts[lang], k=r.randint(1, 4))) for _ in range(30)), lang) for k, lang in ((k, r.choice(list(parts))) for k in range(n))]


def test_languages_are_told_apart(spark):
    rows = corpus(300, 1)
    df = spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 !!", None), (902, "", "bb")], "doc_id long, text string, lang string")
    model = language.profiles(language.training_rows(df))
    got = {r.doc_id: r for r in language.predict(df, model, ["doc_id"]).collect()}
    held = [(k, lang) for k, _, lang in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert held and all(got[k].lang_pred == lang for k, lang in held)
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got.values())


def test_no_training_rows_is_und(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.predict(df, language.profiles(language.training_rows(df)), ["doc_id"]).collect()] == ["und"]


def test_quality_is_learned_from_other_rows(spark):
    r = random.Random(2)
    good = lambda: " ".join(r.choice(["the", "of", "house", "tree", "river"]) for _ in range(60)) + "."
    bad = lambda: " ".join(r.choice(["###", "x9!!", "%%%", "a1b2"]) for _ in range(60))
    rows = [(k, good() if k % 2 else bad(), k % 2) for k in range(300)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q) for k, _, q in rows] + [(7, None)], "doc_id long, quality int")
    texts, marks = quality.training_sample(docs, labels)
    got = {x.doc_id: x.score for x in quality.score(docs, quality.ByteNet().fit(texts, marks)).collect()}
    held = [(k, q) for k, _, q in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert len(texts) == len(rows) - len(held)
    assert sum((got[k] >= 0.3) == bool(q) for k, q in held) >= 0.95 * len(held)
    assert got[900] == got[901] and 0 <= got[900] <= 1


def test_the_last_bytes_count(spark):
    net = quality.ByteNet(seed=5)
    base = b"a" * 5001
    assert net.pooled([base]).tolist() != net.pooled([base + b"zq#!"]).tolist()
    assert net.scores([base, b"", b"zz"]).tolist() == pytest.approx([float(net.scores([t])[0]) for t in (base, b"", b"zz")])
