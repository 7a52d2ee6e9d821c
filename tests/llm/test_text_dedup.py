"""Line dedup, suffix dedup and SimHash against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tomospark.llm import components, line_dedup, simhash, similar, suffix_dedup


def brute_lines(rows, lines=3):
    """Rows in order of doc_id and the text's MD5, each a document of its own; windows by their lines."""
    seen, gone = {}, {}
    md5 = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, md5(rows[k][1])))
    for row in order:
        parts = (rows[row][1] or "").split("\n")
        for k in range(len(parts) - lines + 1):
            window = tuple(parts[k : k + lines])
            if seen.setdefault(window, (row, k)) != (row, k):
                gone.setdefault(row, set()).update(range(k, k + lines))
    out = []
    for row, (doc_id, text, _) in enumerate(rows):
        g = gone.get(row, set())
        if text is None:
            out.append((doc_id, None, 0, 0))
        else:
            parts = text.split("\n")
            out.append((doc_id, "\n".join(p for k, p in enumerate(parts) if k not in g), len(parts), len(g)))
    return sorted(map(repr, out))


def test_lines(spark, documents):
    rng = random.Random(1)
    rows = [(k, "\n".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))), "s") for k in range(40)]
    rows += [(100, None, "s"), (101, "", "s"), (102, "x\ny", "s"), (103, "\n\n\n\n", "s"), (104, "\n\n\n\n", "s"), (105, "q\n" * 2000, "s"), (None, "a\nb\nc\nz", "s")]
    got = line_dedup.deduped(documents(rows).repartition(3))
    assert sorted(repr(tuple(r)) for r in got.select("doc_id", "text", "n_lines", "n_removed").collect()) == brute_lines(rows)
    assert line_dedup.deduped(documents([])).count() == 0
    # rows of null or repeated doc_id are told apart: what no other row holds stays
    unlike = "\n".join("pqrstuv")
    rows += [(None, unlike, "s"), (None, "a\nb\nc\nz\nz", "s"), (None, None, "s"), (7, "K\nL\nM\nN\nO", "s"), (7, "c\na\nb\nc\nd", "s"), rows[3], rows[3], (None, unlike, "s")]
    got = [tuple(r) for r in line_dedup.deduped(documents(rows).repartition(5)).select("doc_id", "text", "n_lines", "n_removed").collect()]
    assert sorted(map(repr, got)) == brute_lines(rows)
    assert {(None, unlike, 7, 0), (None, "", 7, 7), (7, "K\nL\nM\nN\nO", 5, 0)} <= set(got)
    docs = documents(rows)
    kept = line_dedup.dedup_lines(docs)
    assert kept.columns == [*docs.columns, "_n_lines", "n_removed"] and {r.n_lines for r in kept.collect()} == {"n_lines"}


def brute_suffix(rows, size=200):
    raws = [(r[0], (r[1] or "").encode()) for r in rows]
    times = Counter(r[p : p + size] for _, r in raws for p in range(len(r) - size + 1))
    out = []
    for doc_id, raw in raws:
        covered = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - size + 1):
            if times[raw[p : p + size]] > 1:
                covered[p : p + size] = True
        covered = covered[: len(raw)]
        starts = int((covered & ~np.append(False, covered[:-1])[: len(raw)]).sum())
        kept = np.frombuffer(raw, np.uint8)[~covered].tobytes()
        out.append((doc_id, len(raw), int(covered.sum()), starts, hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def suffix_rows():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [word(n) for n in (150, 199, 200, 201, 260, 500, 900)]
    rows = [(1, None, "s"), (2, "", "s"), (3, "a" * 1000, "s"), (4, "ab" * 150, "s"), (5, "ab" * 300, "s"), (None, word(300), "s"), (7, word(250), "s")]
    rows += [(100 + i, "".join(rng.choice([word(rng.randint(1, 200)), rng.choice(shared)]) for _ in range(8)), "s") for i in range(50)]
    for i in range(15):
        near = list(rows[20 + i][1])
        for _ in range(3):
            near[rng.randrange(len(near))] = "z"
        rows.append((300 + i, "".join(near), "s"))
    return rows + [rows[20], rows[21], (999, rows[22][1], "s"), (999, rows[23][1], "s")]


def test_suffixes(spark, documents):
    rows = suffix_rows()
    got = suffix_dedup.digests(documents(rows).repartition(3))
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_suffix(rows)
    assert suffix_dedup.digests(documents([])).count() == 0


@pytest.mark.parametrize("cell", [1, 2, 5])
def test_suffixes_in_small_buckets(spark, documents, cell):
    from pyspark.sql import functions as F

    rows = suffix_rows()
    got = suffix_dedup.cut(documents(rows).repartition(4), cell).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_suffix(rows)


def test_suffixes_under_null_and_equal_ids(spark, documents):
    """Rows without an id of their own are documents of their own."""
    rows = [(None if k % 2 else 7, t, s) for k, (_, t, s) in enumerate(suffix_rows())]
    got = suffix_dedup.digests(documents(rows).repartition(4))
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_suffix(rows)


@pytest.mark.parametrize("mask", [0, 3])
def test_colliding_contexts_are_verified(spark, documents, mask):
    """With context hashes of 1 or 4 values, bytes and digests decide what repeats whole."""
    from pyspark.sql import functions as F

    def collide(batches, mask=mask, plain=suffix_dedup.anchors):
        from tomospark.llm import suffix_dedup as module

        def poor(raw):
            first, number, left, head, context = plain(raw)
            return first, number, left, head, context & np.uint64(mask)

        module.anchors = poor
        try:
            yield from module._anchor_rows(batches)
        finally:
            module.anchors = plain

    rows, own = suffix_rows(), suffix_dedup._anchor_rows
    suffix_dedup._anchor_rows = collide
    try:
        got = suffix_dedup.cut(documents(rows).repartition(6), 5).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    finally:
        suffix_dedup._anchor_rows = own
    assert sorted(repr(tuple(r)) for r in got) == brute_suffix(rows)


def test_crowded_heads_are_split(spark, documents, monkeypatch):
    """A passage that all rows share: its heads are dealt to several tasks and results stay."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = word(260)
    rows = [(k, word(rng.randint(50, 150)) + passage + word(rng.randint(50, 150)), "s") for k in range(120)]
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 2)
    docs = documents(rows).repartition(3)
    table = docs.selectExpr("doc_id AS row", "text").mapInArrow(suffix_dedup._anchor_rows, suffix_dedup.ANCHORS)
    assert suffix_dedup.crowded(table, 10).where("cells > 3").count() > 0
    got = suffix_dedup.cut(docs, 10).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_suffix(rows)


def test_buckets_in_batches():
    """Contexts of a head keep one count over any batches."""
    import pyarrow as pa

    rng = random.Random(9)
    rows = sorted((rng.randint(0, 5), rng.randint(0, 1), rng.randint(0, 40)) for _ in range(300))
    rows = sorted((h, d if h > 3 else 0, c) for h, d, c in rows)
    table = pa.table({"head": [r[0] for r in rows], "dealt": pa.array([r[1] for r in rows], pa.int32()), "cells": pa.array([2 if r[0] > 3 else 1 for r in rows], pa.int32()), "context": [r[2] for r in rows],
                      "state": pa.array([0] * 300, pa.int32()), **{k: pa.array(range(300), pa.int32()) for k in ("first", "number", "left")}, "row": list(range(300))})
    want = pa.Table.from_batches(suffix_dedup._bucket_rows(7)(iter(table.to_batches()))).to_pylist()
    held = suffix_dedup.whole_groups
    try:
        suffix_dedup.whole_groups = lambda batches, key: held(batches, key, 3)
        got = pa.Table.from_batches(suffix_dedup._bucket_rows(7)(iter(table.to_batches(max_chunksize=5)))).to_pylist()
    finally:
        suffix_dedup.whole_groups = held
    order = lambda r: sorted(map(repr, r))
    assert order(got) == order(want)
    shares = {(h, d): len({c for *a, c in rows if a == [h, d]}) for h, d, _ in rows}
    for (h, d), n in shares.items():
        parts = [r["part"] for r in want if r["head"] == h and r["part"] >> 32 == d and not r["whole"]]
        assert len(parts) == n and max(parts) & 0xFFFFFFFF == (n - 1) // 7


def test_suffixes_of_long_text_in_segments(spark, documents, monkeypatch):
    rng = random.Random(5)
    part = "".join(rng.choice("abcdefgh") for _ in range(700))
    long = "".join(rng.choice("abcdefgh") for _ in range(3000))
    rows = [(1, long + part + long[:1000], "s"), (2, part[100:500], "s")]
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 257)
    raw = np.frombuffer(rows[0][1].encode(), np.uint8)
    first, number, left, *_ = suffix_dedup.anchors(raw)
    assert number.sum() == len(raw) - 199 and (left >= 0).all()
    assert sorted(repr(tuple(r)) for r in suffix_dedup.digests(documents(rows)).collect()) == brute_suffix(rows)


def test_colliding_hashes_are_verified(monkeypatch):
    """With a hash that finds everything equal, the bytes decide."""
    rng = np.random.default_rng(2)
    texts = [rng.integers(97, 100, 300).astype(np.uint8) for _ in range(3)]
    texts.append(np.concatenate([texts[0][50:280], texts[1][:70]]))
    raw = np.concatenate(texts)
    begin, left, number = np.arange(4) * 300, np.full(4, 30), np.full(4, 101)
    monkeypatch.setattr(suffix_dedup.Prefix, "hash", lambda self, at, n: np.zeros(len(np.broadcast_arrays(at, n)[0]), np.uint64))
    got = set(zip(*(x.tolist() for x in suffix_dedup.repeated_windows(raw, begin, left, number, np.zeros(4, np.int64))), strict=True))
    want = suffix_dedup._plainly(raw, begin, left, number, np.arange(4))
    assert got == set(zip(*(x.tolist() for x in want), strict=True)) and got


def test_suffix_order():
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 99, 400).astype(np.uint8)
    at, right = rng.integers(0, 200, 60), rng.integers(1, 200, 60)
    bucket = np.sort(rng.integers(0, 4, 60))
    bucket = np.unique(bucket, return_inverse=True)[1]
    order = suffix_dedup.suffix_order(suffix_dedup.Prefix(raw), raw, at, right, bucket)
    want = sorted(range(60), key=lambda i: (bucket[i], raw[at[i] : at[i] + right[i]].tobytes(), i))
    assert order.tolist() == want


def brute_print(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << i for i in range(64) if 2 * sum((x >> i) & 1 for x in h) > len(h))


def test_fingerprints():
    for text in ["", None, " \t", "a b", "The Quick  brown\tfox Jumps É over ÀB the lazy dog", "x y z w " * 500, "a\x1cb c d e f g"]:
        assert simhash.fingerprint(text) == brute_print(text)


def test_anchors_meet():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    other = fp.copy()
    for _ in range(4):
        other ^= np.uint64(1) << rng.integers(0, 64, len(fp)).astype(np.uint64)
    sets = [set(zip(*(x.tolist() for x in simhash.anchors(f)), strict=True)) for f in (fp, other)]
    assert {a for a, _, _ in sets[0] & sets[1]} == set(range(3000))
    assert len(sets[0]) < 13 * 3000


def brute_components(prints, threshold=4):
    ids = list(range(len(prints)))
    root = list(ids)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids[:i]:
            if bin(prints[i] ^ prints[j]).count("1") <= threshold:
                root[find(i)] = find(j)
    return [find(i) for i in ids]


def test_forest_of_bits():
    """Components at an anchor equal those of all pairs, dense clusters and chains among them."""
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 300):
        fp = rng.integers(0, 2**64, n, dtype=np.uint64)
        for k in range(max(1, n // 2), n):
            fp[k] = fp[rng.integers(0, k)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 7)).astype(np.uint64))
        want = brute_components([int(x) for x in fp])
        root = list(range(n))
        for i, j in simhash.forest(fp):
            assert root[j] == j
            root[j] = i
        assert len({(a, b) for a, b in zip(root, want, strict=True)}) == len(set(root)) == len(set(want))


@pytest.mark.parametrize("cell", [8_192, 40])
def test_near_dups(spark, documents, cell):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for g in range(25):
        words = [word() for _ in range(60)]
        rows.append((g * 10, " ".join(words), "s"))
        for c in range(1, 4):
            near = list(words)
            near[rng.randrange(60)] = word()
            rows.append((g * 10 + c, " ".join(near), "s"))
        rows.append((g * 10 + 5, " ".join(words), "s"))
    rows += [(900, None, "s"), (901, "", "s"), (902, " ", "s"), (903, "one", "s")]
    rng.shuffle(rows)
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_dups(documents(rows).repartition(3), cell=cell).collect()}
    prints = [brute_print(t) for _, t, _ in rows]
    roots = brute_components(prints)
    least = {}
    for (doc_id, *_), r in zip(rows, roots, strict=True):
        least[r] = min(least.get(r, doc_id), doc_id)
    assert {d: c for d, (_, c) in got.items()} == {doc_id: least[r] for (doc_id, *_), r in zip(rows, roots, strict=True)}
    assert all(got[doc_id][0] % 2**64 == p for (doc_id, *_), p in zip(rows, prints, strict=True))


def test_near_dups_under_null_and_equal_ids(spark, documents):
    """Rows of one doc_id belong together; rows of null doc_id link like any other."""
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(40))
    a, b, c, d = text(), text(), text(), text()
    rows = [(3, a, "s"), (5, a, "s"), (5, b, "s"), (7, b, "s"), (None, c, "s"), (8, c, "s"), (None, d, "s"), (None, d, "s"), (9, None, "s")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_dups(documents(rows)).collect()), key=repr)
    assert got == sorted([(3, 3), (5, 3), (5, 3), (7, 3), (None, 8), (8, 8), (None, None), (None, None), (9, 9)], key=repr)


def test_hubs(spark, monkeypatch):
    """Nodes of many edges are dealt to several tasks."""
    monkeypatch.setattr(components, "HUB", 3)
    edges = [(500, k) for k in range(40)] + [(k, 1000 + k) for k in range(20)] + [(2000 + k, 2001 + k) for k in range(9)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: 0 for n in [*range(1, 40), 500, *range(1000, 1020)]} | {n: 2000 for n in range(2001, 2010)}


def test_keep_one(spark, documents):
    """One row of each group, whatever its doc_id; among rows alike but for further columns the choice doesn't depend on partitions."""
    rows = [(5, "a b c d e f", "s"), (2, "A b c d e f", "s"), (2, "A b c d e f", "t"), (9, "other words that differ from them all", "s"), (None, "a b c d e f", "s"), (None, "no id", "s"), (None, "no id", "s"), (None, "NO id", "u"), (9, "one id with a second text", "s")]
    docs = documents(rows)
    kept = [similar.keep_one(docs.repartition(n)) for n in (1, 4)]
    assert kept[0].columns == docs.columns
    found = [sorted((r.doc_id or 0, r.text.lower()) for r in k.collect()) for k in kept]
    assert found[0] == found[1] == [(0, "no id"), (2, "a b c d e f"), (9, "one id with a second text"), (9, "other words that differ from them all")]
    assert kept[0].where("doc_id = 2").first().source == kept[1].where("doc_id = 2").first().source
    assert simhash.classes(documents([])).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_copies(texts, similarity=0.8, k=5):
    """A number of the component of each text by the Jaccard similarity of shingle sets."""
    sets = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))})
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("cell", [8_192, 3])
def test_keep_one_reaches_the_similarity(spark, documents, cell):
    """Chains of copies with more and more words changed, many of them over four bits apart."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for g in range(20):
        words = [word() for _ in range(150)]
        for c in range(6):
            near = list(words)
            for p in range(c * (1 + g % 3)):
                near[(7 * p + 3) % 150] = word()
            texts.append(" ".join(near))
            if c == 3:
                words = near
    texts += [None, "", " ", "one", "One", "one two"]
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    roots = brute_copies(texts)
    least = sorted({min(k for k, r in enumerate(roots) if r == x) for x in roots})
    rng.shuffle(rows)
    kept = sorted(r.doc_id for r in similar.keep_one(documents(rows).repartition(3), cell).collect())
    assert kept == least
    bits = [bin(brute_print(a) ^ brute_print(b)).count("1") for a, b in zip(texts, texts[1:], strict=False)]
    assert sum(b > 4 and roots[k] == roots[k + 1] for k, b in enumerate(bits)) > 10


def test_recall_of_bands():
    rng, by, met = np.random.default_rng(5), similar._hashes(), 0
    for _ in range(1000):
        u = rng.integers(0, 2**64, 270, dtype=np.uint64)
        a, b = similar.bands(u[:243], by), similar.bands(np.concatenate([u[:216], u[243:]]), by)  # similarity 0.8
        met += bool((a == b).any())
    assert met >= 995
