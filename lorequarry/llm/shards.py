"""Training-order materialisation: a keyed permutation and fixed-stride shards.

Documents become token ids and are cut into sequences of at most ``LENGTH`` ids.
Each sequence has a dense index, by partition and row; a keyed Feistel network
with cycle-walking permutes the indices, which gives every sequence its slot in
training order without a global sort.  Slots are dealt out by range, and each
range writes its shards: records of one stride, in slot order, so a reader finds
any slot by arithmetic and reads on from there.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorequarry.llm.arrow import pick
from lorequarry.scratch import new_path, spool

#: Ids of a sequence, and sequences of a shard.
LENGTH, SHARD = 1024, 4096
SHARDS_A_PART = 4
KEY = 0x5EED
ROUNDS = 4
#: A record: its number of ids (so many bytes, little-endian), then the ids, padded.
HEAD = 4


@dataclass(frozen=True)
class ByteTokens:
    """UTF-8 bytes as ids, then an end.  Bytes 254 and 255 never stand in UTF-8."""

    end: int = 255
    pad: int = 254

    def count(self, text: Column) -> Column:
        return F.octet_length(text) + 1

    def encode(self, text: str) -> bytes:
        return text.encode("utf-8", "surrogatepass") + bytes([self.end])


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift) of ``x`` under a key."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """A bijection of ``range(n)``: Feistel rounds over the next even power of two,
    walked until the value falls below ``n`` (fewer than four steps on average)."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [zlib.crc32(struct.pack("<QI", key & (1 << 64) - 1, r)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1 for r in range(ROUNDS)]
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            x = out[todo]
            left, right = x >> half, x & mask
            for k in keys:
                left, right = right, left ^ (_mix(right, k) & mask)
            out[todo] = left << half | right
            todo = todo[out[todo] >= n]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Layout:
    """Where things are: enough to read any slot."""

    path: str
    n: int
    length: int = LENGTH
    shard: int = SHARD

    @property
    def stride(self) -> int:
        return HEAD + self.length

    def place(self, slot: int) -> tuple[str, int]:
        """File and byte offset of a slot."""
        return f"{self.path}/shard-{slot // self.shard:08d}.bin", slot % self.shard * self.stride


def _open_dir(path: str):
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def read(layout: Layout, slot: int = 0) -> Iterator[bytes]:
    """The ids of every sequence from ``slot`` on, in training order."""
    while slot < layout.n:
        path, at = layout.place(slot)
        system, path = _open_dir(path)
        with system.open_input_file(path) as f:
            f.seek(at)
            while slot < layout.n and (record := f.read(layout.stride)):
                n = int.from_bytes(record[:HEAD], "little")
                yield record[HEAD : HEAD + n]
                slot += 1


def materialise(docs: DataFrame, path: str | None = None, tokens: ByteTokens = ByteTokens(), key: int = KEY) -> tuple[Layout, DataFrame]:
    """Write the shards of ``docs`` and return their layout and index.

    The index has a row for each sequence: ``slot, shard, byte_offset, doc_id,
    seq_no, n_ids, crc``.  ``docs`` must be a scan of files or a spooled table: its
    partitions are read twice, to count and to write, and a shard whose slots do
    not come out whole fails.  Null and empty texts are one sequence with only the
    end; repeated rows are sequences of their own; an empty table writes nothing;
    other columns are ignored.
    """
    spark = docs.sparkSession
    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n_seqs = F.ceil(tokens.count(F.col("text")) / LENGTH)
    counts = dict(rows.select(F.spark_partition_id().alias("p"), n_seqs.alias("n")).groupBy("p").agg(F.sum("n")).collect())
    starts, n = {}, 0
    for p in sorted(counts):
        starts[p] = n
        n += counts[p]
    layout = Layout(path or new_path(spark, "shards"), n)
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("slot", T.LongType()),
            T.StructField("doc_id", rows.schema["doc_id"].dataType),
            T.StructField("seq_no", T.IntegerType()),
            T.StructField("payload", T.BinaryType()),
        ]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    shipped = spark.sparkContext.broadcast(starts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        at = shipped.value.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                ids, numbers, payloads = [], [], []
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    raw = tokens.encode(text)
                    for k, begin in enumerate(range(0, len(raw), LENGTH)):
                        ids.append(doc_id)
                        numbers.append(k)
                        payloads.append(squeeze(raw[begin : begin + LENGTH]))
                slots = permute(np.arange(at, at + len(ids)), layout.n, key)
                at += len(ids)
                columns = [slots // (layout.shard * SHARDS_A_PART), slots, ids, numbers, payloads]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    n_parts = max(1, -(-n // (layout.shard * SHARDS_A_PART)))
    dealt = rows.mapInArrow(cut, schema).repartitionById(n_parts, F.col("part")).sortWithinPartitions("slot")
    index = spool(_written(dealt, layout, tokens.pad), "shard-index")
    _publish(layout, index.count())
    return layout, index


def _publish(layout: Layout, written: int) -> None:
    """Write the manifest, by which readers know that all shards are there; without
    it the shards are not to be read."""
    if written != layout.n:
        raise RuntimeError(f"{written} of {layout.n} sequences were written: the input changed between two readings")
    system, root = _open_dir(layout.path)
    system.create_dir(root, recursive=True)
    manifest = {"sequences": layout.n, "length": layout.length, "shard": layout.shard, "stride": layout.stride}
    with system.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())


def load(path: str) -> Layout:
    """The layout of published shards."""
    system, root = _open_dir(path)
    with system.open_input_file(f"{root}/manifest.json") as f:
        held = json.loads(f.read())
    return Layout(path, held["sequences"], held["length"], held["shard"])


def _written(dealt: DataFrame, layout: Layout, pad: int) -> DataFrame:
    """Write each range's shards and return their index; a task that runs again
    writes the same bytes, and a file appears whole or not at all."""
    schema = T.StructType(
        [
            T.StructField("slot", T.LongType()),
            T.StructField("shard", T.LongType()),
            T.StructField("byte_offset", T.LongType()),
            dealt.schema["doc_id"],
            T.StructField("seq_no", T.IntegerType()),
            T.StructField("n_ids", T.IntegerType()),
            T.StructField("crc", T.LongType()),
        ]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        system, root = _open_dir(layout.path)
        system.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        out, name, expected = None, "", -1

        def finish() -> None:
            if out is not None:
                if expected % layout.shard and expected != layout.n:
                    raise RuntimeError(f"{name} ends at slot {expected}: the input changed between two readings")
                out.close()
                system.move(f"{name}.{attempt}", name)

        for batch in batches:
            made = []
            for slot, doc_id, seq_no, payload in zip(*(batch[c].to_pylist() for c in ("slot", "doc_id", "seq_no", "payload")), strict=True):
                if out is None or slot // layout.shard != (expected - 1) // layout.shard:
                    finish()
                    name = f"{root}/shard-{slot // layout.shard:08d}.bin"
                    out, expected = system.open_output_stream(f"{name}.{attempt}"), slot // layout.shard * layout.shard
                if slot != expected:
                    raise RuntimeError(f"slot {slot} comes where {expected} should: the input changed between two readings")
                raw = expand(payload)
                record = len(raw).to_bytes(HEAD, "little") + raw.ljust(layout.length, bytes([pad]))
                out.write(record)
                made.append((slot, slot // layout.shard, slot % layout.shard * layout.stride, doc_id, seq_no, len(raw), zlib.crc32(raw)))
                expected += 1
            columns = list(zip(*made, strict=True)) or [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
        finish()

    return dealt.select("slot", "doc_id", "seq_no", "payload").mapInArrow(write, schema)
