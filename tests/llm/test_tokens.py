"""Encoding, token counts and bit planes against whole-text encoding and exact round trips."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tomospark.llm import bitplanes, token_counts, tokens

ODD = ["", None, "É'S don't I'LL x'sy <|startoftext|> a<|endoftext|>b <|ENDOFTEXT|>", "été, İstanbul Kelvin ΣΣ a b c\x1cd\x85e", "1234 a1b2 ... ,. .a, a.. , é. É, ß ẞ Ÿ ÿ.",
       "你好 ßẞ þÞ ×÷ a×b \U0001f600", "A.B,C x.,", "Ǆǅ ﬁ 가  \t\n x\n", "é É", "x y z", "thtionst, " * 3000, "a" * 5000]


def by_slices(enc, texts):
    out = []
    for counts, flat in enc.slices(pa.array(texts, pa.string())):
        at = 0
        for n in counts.tolist():
            out.append(flat[at : at + n].astype("<u4").tobytes())
            at += n
    return out


def test_words_equal_whole_texts(monkeypatch):
    enc = tokens.WordEncoder(memo_words=50)
    monkeypatch.setattr(tokens, "SLICE_BYTES", 2_000)
    texts = ODD + ODD
    assert by_slices(enc, texts) == enc.whole([t or "" for t in texts])
    assert by_slices(enc, []) == []


@given(st.lists(st.text(max_size=60), max_size=6))
@settings(max_examples=150, deadline=None)
def test_words_equal_whole_texts_property(texts):
    enc = tokens.encoder(None)
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    assert by_slices(enc, texts) == enc.whole(texts)


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from([1, 8]), st.sampled_from([1, 7, 64, 65_536]), st.integers(-5, 320), st.integers(-5, 320))
@settings(max_examples=80, deadline=None)
def test_blob_round_trip(ids, unit, block, start, stop):
    ids = np.array(ids, "<u4")
    blob = bitplanes.encode(ids, unit, block)
    assert (bitplanes.decode(blob) == ids).all()
    assert bitplanes.decode_range(blob, start, stop).tolist() == ids[max(0, start) : max(0, stop)].tolist()


def test_partial_reads_leave_other_blocks_packed(monkeypatch):
    ids = np.arange(1_000, dtype="<u4")
    blob, seen, read = bitplanes.encode(ids, 1, 100), [], bitplanes._read_block
    monkeypatch.setattr(bitplanes, "_read_block", lambda *a: seen.append(a[2]) or read(*a))
    assert bitplanes.decode_range(blob, 250, 310).tolist() == list(range(250, 310)) and len(seen) == 2


def test_damaged_blob():
    blob = bytearray(bitplanes.encode(np.arange(1000), 8))
    with pytest.raises(ValueError, match="blob"):
        bitplanes.decode(b"XXXX" + bytes(blob[4:]))
    blob[bitplanes.HEADER.size - 1] ^= 1  # the checksum
    with pytest.raises(ValueError, match="damaged"):
        bitplanes.decode(bytes(blob))


@pytest.mark.parametrize("unit", [1, 8])
def test_corpus(spark, documents, unit):
    rows = [(k * 7 % 50, t, "s") for k, t in enumerate(ODD * 4)] + [(3, "same row", "s"), (3, "same row", "s"), (None, "no id", "s")]
    enc = tokens.encoder(None)
    rows += [(None, f"no id {k}", "s") for k in range(30)]
    docs = documents(rows).repartition(5)
    got = sorted(map(tuple, bitplanes.read_corpus(bitplanes.write_corpus(docs, unit=unit, segment=100)).collect()), key=lambda r: r[1])
    by = lambda t: 42 if t is None else np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, by(r[1]), r[1] is not None, (r[1] or "").encode()))
    at = 0
    assert len(got) == len(rows)
    segments = bitplanes.write_corpus(docs, unit=unit, segment=100)
    stream = b"".join(bytes(r[3]) for r in got)
    for a, b in ((0, 10), (95, 4_321), (5_000, 10**9)):
        parts = sorted(map(tuple, bitplanes.read_range(segments, a, b).collect()))
        assert b"".join(bytes(p[1]) for p in parts) == stream[4 * a : 4 * b] and parts[0][0] == a
    for (doc_id, start, n, ids), (want_id, text, _) in zip(got, want, strict=True):
        expected = enc.whole([text or ""])[0] + np.uint32(tokens.END_ID).tobytes()
        assert (doc_id, start, n, bytes(ids)) == (want_id, at, len(expected) // 4, expected)
        at += n
    digest = {(r.doc_id, r.start): r.ids_crc32 for r in bitplanes.digests(docs).collect()}
    assert all(digest[d, s] == zlib.crc32(bytes(i)) for d, s, _, i in got)


def test_empty_corpus(spark, documents):
    assert bitplanes.digests(documents([])).count() == 0
    assert token_counts.histogram(documents([])).count() == 0


def test_histogram(spark, documents, monkeypatch):
    texts = ODD + ["one two three"] * 5 + [None] * 2
    monkeypatch.setattr(token_counts, "BLOCK", 4)
    hist = token_counts.histogram(documents(texts))
    lens = [len(x) // 4 for x in tokens.encoder(None).whole([t or "" for t in texts])]
    counts = Counter(lens)
    rows = {r.n_tokens: r for r in hist.collect()}
    assert {k: r.n_docs for k, r in rows.items()} == counts
    for limit, r in rows.items():
        assert r.docs_at_least == sum(n >= limit for n in lens)
        assert r.truncated_total == sum(min(n, limit) for n in lens)
        assert r.tokens_in == sum(n for n in lens if n <= limit)
        assert (r.docs_total, r.tokens_total) == (len(lens), sum(lens))
        assert abs(r.quantile - sum(n <= limit for n in lens) / len(lens)) < 1e-12
    one = token_counts.truncated_total(hist, 3).first()
    assert (one.docs, one.tokens, one.kept) == (len(lens), sum(lens), sum(min(n, 3) for n in lens))
