"""Token-ID output as compressed bit or byte planes.

A blob holds a sequence of ids: a header, the chunk index (ids and compressed plane sizes of each
block) and the planes. Each block of BLOCK ids (the last one shorter) is transposed into bit or
byte planes and each plane is compressed with zstandard.

A corpus is a table of segments in ascending doc_id order: shard (partition of the order), seg (within
the shard), first (ids of the shard before it), doc_ids, lens and the blob. Segments end with a
document, so that each can be read alone; one holds SEGMENT ids or a little more, or one long document.
The shards' sizes, one row per partition, give each document's start.

The chunk index serves partial reads: decode_range() unpacks only the blocks that a range of ids touches.

Defined cases: null text is empty, and holds the end id alone; null doc_ids come first; rows of equal
doc_id are ordered by the XXH64 of their text, so that they need not meet in one task, then by text, and each
kept; an empty table gives an empty corpus.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released, write_table
from .tokens import END_ID, default_path, encoder

BLOCK = 65_536
SEGMENT = 4 * BLOCK
MAGIC = b"TSBP"
#: magic, version, 1 for bits or 8 for bytes, planes, block size, number of ids, number of blocks, crc32 of the ids
HEADER = struct.Struct("<4sBBHIQII")


def _to_planes(ids, unit: int, n_planes: int) -> list[bytes]:
    import numpy as np

    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if unit == 8:
        return [octets[:, p].tobytes() for p in range(n_planes)]
    octets = np.ascontiguousarray(octets[:, : (n_planes + 7) // 8].T)
    return [np.packbits((octets[p >> 3] >> (p & 7)) & 1, bitorder="little").tobytes() for p in range(n_planes)]


def _from_planes(planes: list[bytes], n: int, unit: int):
    import numpy as np

    octets = np.zeros((4, n), np.uint8)
    for p, plane in enumerate(planes):
        raw = np.frombuffer(plane, np.uint8)
        if unit == 8:
            octets[p] = raw
        else:
            octets[p >> 3] |= np.unpackbits(raw, count=n, bitorder="little") << (p & 7)
    return np.ascontiguousarray(octets.T).view("<u4").reshape(-1)


def encode(ids, unit: int = 1, block: int = BLOCK, level: int = 1) -> bytes:
    """Blob of a uint32 array; unit 1 makes bit planes, 8 byte planes."""
    import numpy as np
    import zstandard

    ids = np.ascontiguousarray(ids, "<u4")
    bits = int(ids.max()).bit_length() if len(ids) else 0
    n_planes = -(-max(bits, 1) // unit)
    pack = zstandard.ZstdCompressor(level=level).compress
    index, body = [], []
    for at in range(0, len(ids), block):
        part = ids[at : at + block]
        planes = [pack(x) for x in _to_planes(part, unit, n_planes)]
        index.append(struct.pack(f"<{1 + n_planes}I", len(part), *map(len, planes)))
        body += planes
    head = HEADER.pack(MAGIC, 1, unit, n_planes, block, len(ids), len(index), zlib.crc32(ids.tobytes()))
    return b"".join([head, *index, *body])


def _blocks(blob: bytes):
    """Header fields that readers need, and for each block: number of ids, place of its planes and their sizes."""
    magic, version, unit, _n_planes, block, n, n_blocks, crc = HEADER.unpack_from(blob)
    if magic != MAGIC or version != 1:
        raise ValueError("not a bit-plane blob")
    row = struct.Struct(f"<{1 + _n_planes}I")
    at, blocks = HEADER.size + n_blocks * row.size, []
    for k in range(n_blocks):
        count, *sizes = row.unpack_from(blob, HEADER.size + k * row.size)
        blocks.append((count, at, sizes))
        at += sum(sizes)
    return unit, block, n, crc, blocks


def _read_block(blob: bytes, count: int, at: int, sizes, unit: int):
    import zstandard

    unpack, planes = zstandard.ZstdDecompressor().decompress, []
    for s in sizes:
        planes.append(unpack(blob[at : at + s]))
        at += s
    return _from_planes(planes, count, unit)


def decode(blob: bytes, check: bool = True):
    """uint32 array of a blob; ValueError if it is damaged."""
    import numpy as np

    unit, _, n, crc, blocks = _blocks(blob)
    parts = [_read_block(blob, *b, unit) for b in blocks]
    ids = np.concatenate(parts) if parts else np.zeros(0, "<u4")
    if len(ids) != n or check and zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("damaged bit-plane blob")
    return ids


def decode_range(blob: bytes, start: int, stop: int):
    """ids[start:stop] of a blob, from the blocks that hold them alone; the blob's checksum isn't tested."""
    import numpy as np

    unit, block, n, _, blocks = _blocks(blob)
    start, stop = max(0, start), min(stop, n)
    if start >= stop:
        return np.zeros(0, "<u4")
    first = start // block
    parts = [_read_block(blob, *b, unit) for b in blocks[first : (stop - 1) // block + 1]]
    return np.concatenate(parts)[start - first * block : stop - first * block]


SEGMENTS = "shard int, seg int, first long, n_ids long, doc_ids array<long>, lens array<long>, blob binary"


def write_corpus(docs: DataFrame, path: str | None = None, end_id: int = END_ID, unit: int = 1, segment: int = SEGMENT) -> DataFrame:
    """Encode all texts and write their segments to the shared folder; the written table is returned."""
    path = path or default_path()

    def make(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([("shard", pa.int32()), ("seg", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())), ("blob", pa.binary())])
        enc, shard, end = encoder(path), TaskContext.get().partitionId(), np.array([end_id], "<u4")
        seg, first, size, doc_ids, lens, parts = 0, 0, 0, [], [], []

        def flush():
            ids = np.concatenate(parts)
            return pa.RecordBatch.from_pylist([{"shard": shard, "seg": seg, "first": first, "n_ids": len(ids), "doc_ids": doc_ids, "lens": lens, "blob": encode(ids, unit)}], schema)

        for batch in batches:
            names = iter(batch.column(0).to_pylist())
            for counts, flat in enc.slices(batch.column(1)):
                at = 0
                for n in counts.tolist():
                    parts += [flat[at : at + n], end]
                    doc_ids.append(next(names))
                    lens.append(n + 1)
                    at += n
                    size += n + 1
                    if size >= segment:
                        yield flush()
                        seg, first, size, doc_ids, lens, parts = seg + 1, first + size, 0, [], [], []
        if doc_ids:
            yield flush()

    # null or equal doc_ids are parted by a hash of the text
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_by"))
    ordered = rows.repartitionByRange("doc_id", "_by").sortWithinPartitions("doc_id", "_by", "text").drop("_by")
    return write_table(ordered.mapInArrow(released(make), SEGMENTS), "tokens")


def _placed(segments: DataFrame) -> DataFrame:
    """segments with _at, the number of ids before them."""
    # one row per shard, so at most one per partition of the writer
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    shards = shards.select("shard", (F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).alias("_before"))
    return segments.join(F.broadcast(shards), "shard").withColumn("_at", F.col("first") + F.col("_before"))


def read_corpus(segments: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian uint32 bytes)."""

    def take(batches):
        import pyarrow as pa

        names = ["doc_id", "start", "n_tokens", "ids"]
        for batch in batches:
            for row in batch.to_pylist():
                raw, at, starts, ids = decode(row["blob"]).tobytes(), 0, [], []
                for n in row["lens"]:
                    starts.append(row["_at"] + at)
                    ids.append(raw[4 * at : 4 * (at + n)])
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(row["lens"], pa.int64()), pa.array(ids, pa.binary())], names)

    rows = _placed(segments).select("_at", "doc_ids", "lens", "blob")
    return rows.mapInArrow(released(take), "doc_id long, start long, n_tokens long, ids binary")


def read_range(segments: DataFrame, start: int, stop: int) -> DataFrame:
    """start and ids: the parts of the corpus's ids start to stop; other segments are skipped and other blocks left packed."""

    def take(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                first = max(start - row["_at"], 0)
                ids = decode_range(row["blob"], first, stop - row["_at"]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([row["_at"] + first], pa.int64()), pa.array([ids], pa.binary())], ["start", "ids"])

    rows = _placed(segments).where((F.col("_at") < stop) & (F.col("_at") + F.col("n_ids") > start)).select("_at", "blob")
    return rows.mapInArrow(released(take), "start long, ids binary")


def digests(docs: DataFrame) -> DataFrame:
    """Write the corpus, read it back and give each document's place and checksum."""
    return read_corpus(write_corpus(docs)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
