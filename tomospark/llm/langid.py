"""Language ID by language-bitmask n-gram filters.

Training takes, for each language, its n-grams of ORDERS letters (lower-cased; what is not a letter is a
space) that make up at least SHARE of the language's n-grams of that order: at most 1 / SHARE of them, so
the set is bounded whatever the corpus. They go into Bloom filters that are sliced by bit: a slot holds one
bit per language, and the AND of an n-gram's slots is the mask of all languages that contain it.
A text's n-grams are looked up, each language's bits are counted, and the counts are corrected for the
filter's false positives: (hits - n * fp) / (1 - fp), with fp = fill ** HASHES. The largest count decides;
the score is its share of the sum of counts, and evidence is its share of the text's n-grams.

Every labelled row that isn't held out is learned from, and keep_known's threshold is a quantile of every
labelled row that is: neither is sampled.

Defined cases: null text, or text without a letter, is "und" with score 0, as is everything when there
is no labelled row; a text that hits no filter gets the language with most training documents and
score 0; ties go to the smaller name; rows of null doc_id are neither held out nor learned from; null
langs aren't learned; any further columns are kept by keep_known and ignored otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, fresh, release, released, write_table

ORDERS = (2, 3, 4)
SHARE = 1e-4
HASHES = 3
SLOTS_PER_GRAM = 8
#: A text is rejected below this evidence, or below LEEWAY of the QUANTILE of the held-out labelled texts' evidence.
EVIDENCE = 0.1
LEEWAY, QUANTILE = 0.5, 0.02
CHUNK = 1 << 19
#: A task that counts n-grams holds at most about this many hashes, and as many counted ones.
HELD = 1 << 20
#: Ranges that a round of quantile() counts.
BINS = 4_096

_fold = None


def _folding():
    """Code point -> lower-case letter, or a space for what is not a letter."""
    global _fold
    if _fold is None:
        import numpy as np

        _fold = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if (ch := chr(c)).isalpha():
                low = ch.lower()
                _fold[c] = ord(low) if len(low) == 1 else c
    return _fold


def grams(text: str):
    """For each chunk of the text and each order: the order and its n-grams as uint64 hashes."""
    import numpy as np

    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    held = np.array([32], np.uint32)
    for at in range(0, max(len(cps), 1), CHUNK):
        part = _folding()[cps[at : at + CHUNK]]
        if at + CHUNK >= len(cps):
            part = np.append(part, np.uint32(32))
        part = np.concatenate([held, part])
        keep = np.ones(len(part), bool)
        keep[1:] = (part[1:] != 32) | (part[:-1] != 32)
        part = part[keep].astype(np.uint64)
        if not (part != 32).any():
            held = part[-1:].astype(np.uint32)
            continue
        h = part * np.uint64(0x9E3779B97F4A7C15)
        for n in range(2, max(ORDERS) + 1):
            h = h[:-1] * np.uint64(0xD6E8FEB86659FD93) + part[n - 1 :] * np.uint64(0xC2B2AE3D27D4EB4F)
            if n in ORDERS and len(h):
                yield n, h ^ (h >> np.uint64(29))
        held = part[-(max(ORDERS) - 1) :].astype(np.uint32)


def _slots(h, k: int, bits: int):
    import numpy as np

    mixed = (h ^ np.uint64(0xA5A5A5A5 * (k + 1))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
    return ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - bits)


@dataclass
class Model:
    langs: list[str]  # by name
    most: int  # index of the language with most training documents
    bits: int  # log2 of the slots
    table: object  # (bytes of a mask, slots) uint8: the bit-sliced filters
    fp: object  # false-positive rate per language

    def counts(self, text: str):
        """Corrected hits per language, and the number of n-grams."""
        import numpy as np

        hits, total = np.zeros(8 * len(self.table), np.int64), 0
        for _, h in grams(text):
            total += len(h)
            slots = [_slots(h, k, self.bits) for k in range(HASHES)]
            for b, rows in enumerate(self.table):
                mask = rows[slots[0]]
                for s in slots[1:]:
                    mask = mask & rows[s]
                hits[8 * b : 8 * b + 8] += np.bincount(mask, minlength=256) @ _BITS()
        hits = hits[: len(self.langs)]
        return np.maximum(0, (hits - total * self.fp) / (1 - self.fp)), total

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and evidence."""
        if not self.langs or not text or not any(c.isalpha() for c in text):
            return "und", 0.0, 0.0
        found, total = self.counts(text)
        best = int(found.argmax())
        if not found[best]:
            return self.langs[self.most], 0.0, 0.0
        return self.langs[best], min(1.0, float(found[best] / found.sum())), min(1.0, float(found[best] / total))


def _BITS():
    import numpy as np

    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


class Counts:
    """The n-grams of a task's texts, counted by language and order."""

    def __init__(self):
        self.new: dict = {}  # hashes not counted yet
        self.old: dict = {}  # ascending hashes and their counts
        self.n_new = 0

    def add(self, lang: str, text: str):
        """Count a text; taken(), if too many would be held."""
        for n, h in grams(text):
            self.new.setdefault((lang, n), []).append(h)
            self.n_new += len(h)
            if self.n_new >= HELD:
                self.merge()
                if sum(len(h) for h, _ in self.old.values()) >= HELD:
                    yield from self.taken()

    def merge(self) -> None:
        import numpy as np

        for key, parts in self.new.items():
            h, times = np.unique(np.concatenate(parts), return_counts=True)
            if key in self.old:
                before, n_before = self.old[key]
                both, at = np.unique(np.concatenate([before, h]), return_inverse=True)
                sums = np.zeros(len(both), np.int64)
                np.add.at(sums, at, np.concatenate([n_before, times]))
                h, times = both, sums
            self.old[key] = h, times
        self.new, self.n_new = {}, 0

    def taken(self):
        """The counts as Arrow batches; they are forgotten."""
        import numpy as np
        import pyarrow as pa

        self.merge()
        for (lang, n), (h, times) in self.old.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h)), pa.array(np.full(len(h), n, np.int32)), pa.array(h.view(np.int64)), pa.array(times)], ["lang", "n", "gram", "times"])
        self.old = {}


def fit(docs: DataFrame, share: float = SHARE) -> Model:
    """Learn from all rows that are not held out; one row per language and the kept n-grams come to the driver."""
    import numpy as np

    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    n_docs = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.count("*")).collect()}
    langs = sorted(n_docs)
    if not langs:
        return Model([], 0, 1, np.zeros((1, 2), np.uint8), np.zeros(0))

    def count(batches):
        counts = Counts()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from counts.add(lang, text)
        yield from counts.taken()

    counted = rows.select("lang", "text").mapInArrow(released(count), "lang string, n int, gram long, times long")
    counted = counted.groupBy("lang", "n", "gram").agg(F.sum("times").alias("times"))
    totals = counted.groupBy("lang", "n").agg(F.sum("times").alias("total"))
    # totals: one row per language and order
    kept = counted.join(F.broadcast(totals), ["lang", "n"]).where(F.col("times") >= F.col("total") * share).select("lang", "gram").collect()

    code = {x: i for i, x in enumerate(langs)}
    lang = np.array([code[r[0]] for r in kept], np.int64)
    gram = np.array([r[1] for r in kept], np.int64).view(np.uint64)
    largest = int(np.bincount(lang, minlength=1).max()) if len(lang) else 1
    bits = max(10, (SLOTS_PER_GRAM * largest - 1).bit_length())
    table = np.zeros((-(-len(langs) // 8), 1 << bits), np.uint8)
    for k in range(HASHES):
        np.bitwise_or.at(table, (lang >> 3, _slots(gram, k, bits).astype(np.int64)), (1 << (lang & 7)).astype(np.uint8))
    fill = np.array([((table[i >> 3] >> (i & 7)) & 1).mean() for i in range(len(langs))])
    return Model(langs, langs.index(max(langs, key=n_docs.get)), bits, table, fill**HASHES)


def predicted(docs: DataFrame, model: Model) -> Column:
    """Column of struct<lang, score, evidence>, of text alone."""
    # bounded by (languages / 8) * SLOTS_PER_GRAM * orders / SHARE bytes
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(text: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([shared.value.predict(t) for t in text], columns=["lang", "score", "evidence"])
        release()
        return found

    # as if not deterministic: a filter on it must not run it a second time
    return F.pandas_udf(predict, "lang string, score double, evidence double").asNondeterministic()(F.col("text"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row."""
    docs = docs.select("doc_id", "text", "lang")
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predicted(docs, fit(docs)).alias("_found"))
    return found.select("doc_id", "held_out", F.col("_found.lang").alias("lang_pred"), F.col("_found.score").alias("score"))


def quantile(numbers: DataFrame, at: float) -> float | None:
    """As np.quantile of the one column of finite numbers, exactly; None if there are none.

    Each round counts the rows of BINS ranges between the two neighbours' bounds; a row per range comes to the driver.
    """
    import numpy as np

    x = F.col(numbers.columns[0])
    stats = [F.min(x), F.max(x), F.count(x)]
    low, high, n = numbers.agg(*stats).first()
    if not n:
        return None
    first = int(at * (n - 1))
    second, rest = min(first + 1, n - 1), at * (n - 1) - first
    while low < high:
        # rises with x, whatever is rounded; low and high fall apart
        place = F.floor((x - low) / (high - low) * BINS)
        ranges = numbers.where(x.between(low, high)).groupBy(place.alias("place")).agg(*stats).orderBy("place").collect()
        ends = np.cumsum([r[3] for r in ranges])
        one, two = (int(np.searchsorted(ends, k, side="right")) for k in (first, second))
        if one != two:
            return float(np.quantile([ranges[one][2], ranges[two][1]], rest))
        before = int(ends[one]) - ranges[one][3]
        low, high, first, second = ranges[one][1], ranges[one][2], first - before, second - before
    return low


def least_evidence(docs: DataFrame, model: Model) -> float:
    """The evidence below which a text is of none of the learned languages, from all labelled texts that weren't learned from."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & held_out(F.col("doc_id"))).select("text")
    found = rows.select(predicted(rows, model).alias("found")).where("found.lang <> 'und'").select("found.evidence")
    # one number per row
    numbers = write_table(found, "evidence")
    least = quantile(numbers, QUANTILE)
    drop_table(numbers)
    return LEEWAY * least if least is not None else 0.0


def keep_known(docs: DataFrame, evidence: float = EVIDENCE) -> DataFrame:
    """docs without those that have no letter or too little evidence for any learned language."""
    (name,) = fresh(docs, "_found")
    model = fit(docs)
    evidence = max(evidence, least_evidence(docs, model))
    found = docs.withColumn(name, predicted(docs, model))
    return found.where((F.col(name)["lang"] != "und") & (F.col(name)["evidence"] >= evidence)).drop(name)
