"""Encoding of whole texts with a public tokenizer, by distinct words.

word_bpe_49k drops white space and looks at nothing beyond it, so a text's ids are its words' ids in
order (a test compares this with whole-text encoding). Arrow cuts a slice of texts into words and numbers the
distinct ones; each is encoded once and the ids are gathered by number. Words of Latin-1 letters,
with or without one full stop or comma, are cut there as the pre-tokenizer does and given to the
library's BPE model itself; all others pass the whole tokenizer. Words seen are kept in bounded memos.
"""

from __future__ import annotations

import os
import struct

END_ID = 2
#: Letters of Latin-1, which normalisation leaves alone and which stay together, and one mark or none.
PLAIN = "^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<end>[.,]?)$"
SLICE_BYTES = 6_000_000
_encoders: dict = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, int]:
    """The public byte-level alphabet: printable Latin-1 stays, the others follow from 256 in order."""
    stay = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in stay]
    return {b: b for b in stay} | {b: 256 + k for k, b in enumerate(other)}


class WordEncoder:
    """ids of texts as uint32 arrays; the memos hold about memo_words plain and a third as many other words at most."""

    def __init__(self, path: str | None = None, memo_words: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.cores: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {"": b""}
        self.memo_words = memo_words
        #: a mark that isn't one token stays with its word
        self.marks = {m: struct.unpack("<I", ids)[0] for m, ids in zip(".,", self.whole([".", ","]), strict=True) if len(ids) == 4}
        self.plain = PLAIN.replace("[.,]?", f"[{''.join(self.marks)}]?" if self.marks else "")

    def whole(self, texts: list[str]) -> list[bytes]:
        """The texts through the whole tokenizer; ids as little-endian uint32 bytes."""
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _core(self, core: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(core if core.isascii() else core.encode().decode("latin-1").translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _words(self, words):
        """Number of ids of each of the distinct words (an Arrow array), and all their ids in a row."""
        import numpy as np
        import pyarrow.compute as pc

        cut = pc.extract_regex(words, self.plain)
        is_plain = pc.is_valid(cut)
        cores = pc.if_else(is_plain, pc.utf8_lower(pc.struct_field(cut, "core")), None).dictionary_encode()
        known, make, pieces = self.cores, self._core, []
        if len(known) > self.memo_words:
            known.clear()
        for core in cores.dictionary.to_pylist():
            ids = known.get(core)
            if ids is None:
                ids = known[core] = make(core)
            pieces.append(ids)
        n_cores, other = len(pieces), words.filter(pc.invert(is_plain)).to_pylist()
        if len(self.others) > self.memo_words // 3:
            self.others = {"": b""}
        new = [w for w in other if w not in self.others]
        self.others.update(zip(new, self.whole(new), strict=True))
        pieces += map(self.others.__getitem__, other)

        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        pool = np.frombuffer(b"".join(pieces), "<u4")
        plain = is_plain.to_numpy(zero_copy_only=False)
        which = np.empty(len(words), np.int64)
        which[plain] = cores.indices.drop_null().to_numpy()
        which[~plain] = n_cores + np.arange(len(other))
        mark, ends = np.zeros(len(words), np.uint32), pc.struct_field(cut, "end")
        marked = np.zeros(len(words), bool)
        for sign, number in self.marks.items():
            has = pc.fill_null(pc.equal(ends, sign), False).to_numpy(zero_copy_only=False)
            mark[has], marked = number, marked | has
        size = sizes[which]
        lens = size + marked
        begin = np.cumsum(lens) - lens
        out = np.empty(int(lens.sum()), "<u4")
        nth = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(begin, size) + nth] = pool[np.repeat((np.cumsum(sizes) - sizes)[which], size) + nth]
        out[(begin + size)[marked]] = mark[marked]
        return lens, out

    def slices(self, texts, ids: bool = True):
        """For slices of texts (an Arrow string array) in order: tokens of each text, and all ids in a row or None."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, "right")))
            lists = pc.ascii_split_whitespace(pa.concat_arrays([texts.slice(at, end - at)]))
            numbered = lists.flatten().dictionary_encode()
            lens, held = self._words(numbered.dictionary)
            index = numbered.indices.to_numpy()
            count = lens[index]
            until = np.append(0, np.cumsum(count))
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = None
            if ids:
                begin = (np.cumsum(lens) - lens)[index] - until[:-1]
                flat = held[np.repeat(begin.astype(np.int32), count) + np.arange(until[-1], dtype=np.int32)]
            yield until[offsets[1:]] - until[offsets[:-1]], flat
            at = end
            del lists, numbered, held, index, count, flat
            pa.default_memory_pool().release_unused()


def encoder(path: str | None = None) -> WordEncoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
