"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts are sequences of words (runs of letters and digits of the lower-cased text, as 64-bit hashes). A
document leaks an item of n words if some stretch of it is within floor((1 - SIMILARITY) * n) = d word
edits (insertions, deletions, replacements) of the item.

1. Windows. Of all windows of an item's size only those are looked at that can hold a leak: an item is cut into
   d + 1 runs of words; d edits leave one of them whole, so a leak holds one of the item's runs, and the
   item-sized window that lays this run on its place in the item covers it. This prefilter loses nothing;
   embedding all windows instead costs 3n steps for each word, size and walk.
2. CGK. A random walk embeds a window (3n steps; a step emits the current word and moves on or stays by a
   random bit of step and word), which turns edit distance into Hamming distance. REPEATS walks are made.
3. LSH. TABLES tables each sample SAMPLES steps of a walk's first STEPS * n, and only those are made; windows and
   items that agree there are candidates.
   RECALL below is measured by tests: at the largest distance, d, and over all item-sized windows of texts
   without the prefilter, against plain edit distance.
4. Verification: the exact least edit distance of the item to any stretch of the window and d words
   either side, by Myers' bit vectors.

Items too short for an edit (d = 0, fewer than five words) need no embedding: equal words are looked up. An item of one common word
is in many documents, so min_words can leave such items out.

Items come to the executors in blocks of BLOCK_WORDS words at most (or one longer item), however many there are;
a block's results are written before the next one comes.

Defined cases: null or empty texts leak nothing and null or empty items are not
searched for; repeated items and rows each count; bytes above 127 count as letters; of scripts that are
written without spaces (SOLO) each character is a word.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, release, released, write_table
from .suffix_dedup import Prefix, _mix

SIMILARITY = 0.8
MIN_WORDS = 1
REPEATS = 8
TABLES = 128
SAMPLES = 2
#: Steps are sampled from the first STEPS * n of the walk's 3n. A walk leaves n words after 2n steps on average;
#: from there on all walks emit the same, so samples of such steps would agree for any two windows.
STEPS = 1.7
RECALL = 0.95
BLOCK_WORDS = 1_000_000
SEED = 42
#: First and last code points of scripts without spaces: Thai to Myanmar, Khmer, CJK marks and kana, ideographs, halfwidth kana.
SOLO = ((0x0E00, 0x109F), (0x1780, 0x17FF), (0x3000, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))
_solo = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in SOLO) + "]"
#: What words() finds, as a pattern.
WORDS = rf"{_solo}|(?:(?!{_solo})[0-9A-Za-z\x{{80}}-\x{{10FFFF}}])+"

_letters = None


def lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _cuts(raw):
    """Where characters of SOLO begin and end in UTF-8 bytes."""
    import numpy as np

    at = np.flatnonzero(raw >= 0xE0)  # leads of three or four bytes
    if not len(at):
        return at
    four = raw[at] >= 0xF0
    low = lambda k: (raw[np.minimum(at + k, len(raw) - 1)] & 0x3F).astype(np.int64)
    lead = raw[at].astype(np.int64)
    cp = np.where(four, (lead & 7) << 18 | low(1) << 12 | low(2) << 6 | low(3), (lead & 15) << 12 | low(1) << 6 | low(2))
    solo = np.any([(cp >= a) & (cp <= b) for a, b in SOLO], axis=0)
    return np.union1d(at[solo], at[solo] + np.where(four, 4, 3)[solo])


def words(raw):
    """Hashes, first bytes and end bytes of the words of lower-cased UTF-8 bytes (a uint8 array)."""
    global _letters
    import numpy as np

    if _letters is None:
        _letters = np.array([b > 127 or chr(b).isalnum() for b in range(256)])
    edge = np.flatnonzero(np.diff(_letters[raw].astype(np.int8), prepend=0, append=0))
    begin, end = edge[::2], edge[1::2]
    cuts = _cuts(raw)
    if len(cuts):
        letter = np.append(_letters[raw], False)
        begin = np.union1d(begin, cuts[letter[cuts]])
        end = np.union1d(end, cuts[letter[cuts - 1] & (cuts > 0)])
    size = end - begin
    # long texts in parts, so that the hash's tables stay small
    out, step = np.zeros(len(begin), np.uint64), 1 << 18
    for k in range(0, len(begin), 1 << 16):
        a, b = begin[k : k + (1 << 16)], size[k : k + (1 << 16)]
        if int(a[-1] + b[-1] - a[0]) <= step:
            out[k : k + (1 << 16)] = Prefix(raw[a[0] : a[-1] + b[-1]]).hash(a - a[0], b)
        else:
            for x in range(len(a)):
                out[k + x] = Prefix(raw[a[x] : a[x] + b[x]]).hash(np.array([0]), np.array([b[x]]))[0]
    out = _mix(out ^ size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.where(out == 0, np.uint64(1), out), begin, begin + size


def runs(hashes, size: int):
    """Hash of each run of size words."""
    import numpy as np

    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = hashes[:n].copy()
    for k in range(1, size):
        h = _mix(h * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n])
    return h


def distance(item: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of item to any stretch of text, and the end of the first such stretch (Myers)."""
    m = len(item)
    peq: dict[int, int] = {}
    for i, w in enumerate(item):
        peq[w] = peq.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, w in enumerate(text):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Index:
    """A block of items: the tables of their runs, and their embeddings' LSH tables."""

    def __init__(self, items, similarity=SIMILARITY, repeats=REPEATS, tables=TABLES, samples=SAMPLES, seed=SEED, min_words=MIN_WORDS):
        import numpy as np

        rng = np.random.default_rng(seed)
        items = [(i, w) for i, w in items if len(w) >= max(1, min_words)]
        self.ids, self.items = [i for i, _ in items], [w for _, w in items]
        self.sizes = np.array([len(w) for w in self.items], np.int64)
        # a share like 0.2 * 35 must not fall short of 7
        self.edits = np.floor((1 - similarity) * self.sizes + 1e-9).astype(np.int64)
        self.longest = int(self.sizes.max()) if len(items) else 0
        by_size: dict[int, list] = {}
        #: items without an edit by their number of words: sorted hashes and items
        self.exact = {int(n): None for n in self.sizes[self.edits == 0]}
        for n in self.exact:
            same = np.flatnonzero((self.sizes == n) & (self.edits == 0))
            h = np.array([runs(self.items[k], n)[0] for k in same], np.uint64)
            order = np.argsort(h, kind="stable")
            self.exact[n] = (h[order], same[order])
        for k, (w, n, d) in enumerate(zip(self.items, self.sizes, self.edits, strict=True)):
            if not d:
                continue
            size = int(n // (d + 1))
            for r, h in enumerate(runs(w, size)[:: size][: d + 1]):
                by_size.setdefault(size, []).append((int(h), k, r * size))
        self.runs = {}
        for size, rows in by_size.items():
            rows.sort()
            h = np.array([r[0] for r in rows], np.uint64)
            seen = np.zeros(1 << 18, bool)
            seen[h >> np.uint64(46)] = True
            self.runs[size] = (seen, h, np.array([self.sizes[r[1]] for r in rows]), np.array([r[2] for r in rows]))
        self.bits = [rng.integers(0, 2, (int(STEPS * self.longest) + 1, 256), dtype=np.int64) for _ in range(repeats)]
        self.at = rng.random((tables, samples))
        self.tables = []
        loose = np.flatnonzero(self.edits > 0)
        if len(loose):
            flat, begin = np.concatenate(self.items), np.cumsum(self.sizes) - self.sizes
            for keys in self.keys(flat, begin[loose], self.sizes[loose]):
                order = np.argsort(keys, kind="stable")
                self.tables.append((keys[order], loose[order]))

    def windows(self, hashes):
        """First words and sizes of the windows that a run of an item points to; each once."""
        import numpy as np

        found = []
        for size, (seen, h, n, offset) in self.runs.items():
            have = runs(hashes, size)
            at = np.flatnonzero(seen[have >> np.uint64(46)])
            low, high = np.searchsorted(h, have[at]), np.searchsorted(h, have[at], "right")
            times = high - low
            row = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            found.append(np.maximum(np.repeat(at, times) - offset[row], 0) << 24 | n[row])
        key = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return key >> 24, key & 0xFFFFFF

    def equal(self, hashes):
        """(first word, item) of the first place of each item without an edit."""
        import numpy as np

        out = []
        for n, (h, items) in self.exact.items():
            have = runs(hashes, n)
            low, high = np.searchsorted(h, have), np.searchsorted(h, have, "right")
            at = np.flatnonzero(low < high)
            for entry in np.unique(low[at]).tolist():
                places = at[low[at] == entry]
                for k in items[h == h[entry]].tolist():
                    first = next((p for p in places.tolist() if (hashes[p : p + n] == self.items[k]).all()), None)
                    if first is not None:
                        out.append((first, k))
        return out

    def keys(self, flat, start, size):
        """For each table the windows' keys."""
        import numpy as np

        out = np.empty((len(self.at), len(start)), np.uint64)
        for k in range(0, len(start), 8_192):
            s, n = start[k : k + 8_192], size[k : k + 8_192]
            for r, bits in enumerate(self.bits):
                walk = np.zeros((int(STEPS * n.max()) + 1, len(s)), np.uint64)
                at, end = s.copy(), s + n
                for step in range(len(walk)):
                    word = np.where(at < end, flat[np.minimum(at, len(flat) - 1)], np.uint64(0))
                    walk[step] = word
                    at += bits[step][(word & np.uint64(255)).astype(np.int64)]
                for t in range(r, len(self.at), len(self.bits)):
                    key = n.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
                    for u in self.at[t]:
                        key = _mix(key ^ walk[(u * STEPS * n).astype(np.int64), np.arange(len(s))]) + np.uint64(1)
                    out[t, k : k + 8_192] = key
        return out

    def candidates(self, flat, start, size):
        """Pairs (window, item) that agree in a table."""
        import numpy as np

        pairs = []
        for keys, (have, order) in zip(self.keys(flat, start, size), self.tables, strict=True):
            low, high = np.searchsorted(have, keys), np.searchsorted(have, keys, "right")
            times = high - low
            row = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            pairs.append(np.repeat(np.arange(len(start)), times) << 32 | order[row])
        key = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        return key >> 32, key & 0xFFFFFFFF

    def search(self, texts):
        """For each leak: (number of the text, number of the item, edits, first and end code point)."""
        import numpy as np

        held, where, flat, base, best = [], [], [], 0, {}
        gap = np.zeros(self.longest + 1, np.uint64)
        for t, text in enumerate(texts):
            if not text or not self.items:
                continue
            raw = lowered(text).encode()
            hashes, begin, end = words(np.frombuffer(raw, np.uint8))
            for first, k in self.equal(hashes):
                best[t, k] = (0, len(raw[: begin[first]].decode()), len(raw[: end[first + self.sizes[k] - 1]].decode()))
            start, size = self.windows(hashes)
            if len(start):
                held.append((start, size, np.full(len(start), len(where))))
                where.append((t, raw, hashes, begin, end, base))
                flat += [hashes, gap]
                base += len(hashes) + len(gap)
        if not held:
            return [(t, i, *x) for (t, i), x in sorted(best.items())]
        start, size, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        bases = np.array([w[5] for w in where])
        window, item = self.candidates(np.concatenate(flat), start + bases[doc], size)
        for w, i in zip(window.tolist(), item.tolist(), strict=True):
            t, raw, hashes, begin, end, _ = where[doc[w]]
            d, n = int(self.edits[i]), int(self.sizes[i])
            low, high = max(0, int(start[w]) - d), int(start[w]) + n + d
            part = hashes[low:high].tolist()
            pattern = self.items[i].tolist()
            edits, stop = distance(pattern, part)
            if edits <= d:
                _, back = distance(pattern[::-1], part[:stop][::-1])
                first, last = low + stop - back, low + stop - 1
                found = (edits, len(raw[: begin[first]].decode()), len(raw[: end[last]].decode()))
                best[t, i] = min(best.get((t, i), found), found)
        return [(t, i, *x) for (t, i), x in sorted(best.items())]


def blocks(benchmark: DataFrame, **options):
    """Indexes over the items, of at most about BLOCK_WORDS words each."""
    import numpy as np

    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL")
    rows, size = items.agg(F.count("*"), F.sum(F.regexp_count("text", F.lit(WORDS)))).first()
    n = max(1, -(-size // BLOCK_WORDS)) if rows else 0
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        hashed = [(i, words(np.frombuffer(lowered(t).encode(), np.uint8))[0]) for i, t in sorted(block.collect(), key=str)]
        yield Index(hashed, **options)


LEAKS = "doc_id long, item_id long, edits int, item_words int, similarity double, start int, end int"


def leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """A row for each document and item that it leaks, with the best stretch, in code points."""
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    for index in blocks(benchmark, **options):
        shared = spark.sparkContext.broadcast(index)  # bounded by BLOCK_WORDS

        def find(batches, shared=shared):
            import pyarrow as pa

            index = shared.value
            for batch in batches:
                found = index.search(batch.column(1).to_pylist())
                at = pa.array([f[0] for f in found], pa.int64())
                sizes = [int(index.sizes[f[1]]) for f in found]
                columns = [
                    batch.column(0).take(at), pa.array([index.ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int32()), pa.array(sizes, pa.int32()),
                    pa.array([1 - f[2] / n for f, n in zip(found, sizes, strict=True)], pa.float64()), pa.array([f[3] for f in found], pa.int32()), pa.array([f[4] for f in found], pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in LEAKS.split(", ")])

        # written, so that one block at a time is on the executors
        part = write_table(rows.mapInArrow(released(find), LEAKS), "leaks")
        shared.destroy()
        out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], LEAKS)


def leaking(shared) -> Column:
    """Whether text leaks an item of the block; shared: a broadcast index."""

    def test(text: pd.Series) -> pd.Series:
        hit = {f[0] for f in shared.value.search(text.tolist())}
        release()
        return pd.Series([k in hit for k in range(len(text))], dtype=bool)

    return F.pandas_udf(test, "boolean").asNondeterministic()(F.col("text"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that leak an item. Rows that a block leaves are written before the next block comes; the last one is lazy."""
    (name,) = fresh(docs, "_leaks")
    shared = None
    for index in blocks(benchmark, **options):
        if shared is not None:
            docs = write_table(docs, "clean")
            shared.destroy()
        shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by BLOCK_WORDS
        docs = docs.withColumn(name, leaking(shared)).where(~F.col(name)).drop(name)
    return docs
