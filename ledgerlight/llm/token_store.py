"""Token-id shards with Elias-Fano encoded document boundaries.

One shard is one file: the ids of all its documents one after another, then the
boundaries and the (sorted) document ids as Elias-Fano sequences, then a JSON
footer, its length and the magic. A monotone sequence of n values below u takes
n * (2 + log2(u / n)) bits; every ``SAMPLE``-th one-bit's position is stored, so
``select`` touches a few bytes of the high part and no 64-bit offset table exists.

Null texts are empty documents (the end id alone). A null document id sorts
first. Equal ids keep one entry per row. An empty input gives no shard.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.cluster import fresh_path, materialize
from ledgerlight.llm.subword import UnitEncoder, encode_documents

MAGIC = b"EFTOKEN1"
SAMPLE = 256
_SLICE = 1 << 21


class EliasFano:
    """A non-decreasing sequence of integers >= 0, in near-minimal space."""

    def __init__(self, n: int, low_bits: int, high: np.ndarray, low: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.high, self.low, self.samples = n, low_bits, high, low, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        bound = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (bound // max(n, 1)).bit_length() - 1)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        planes = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(planes.astype(np.uint8).ravel(), bitorder="little")
        return cls(n, low_bits, np.packbits(bits, bitorder="little"), low, ones[::SAMPLE].astype(np.uint32 if len(bits) < 1 << 32 else np.uint64))

    def _low(self, lo: int, hi: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(hi - lo, np.uint64)
        a, b = lo * self.low_bits, hi * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 :][: b - a]
        return bits.reshape(-1, self.low_bits).astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))

    def select(self, i: int) -> int:
        """The i-th value (from 0), from the nearest sample on."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = at // 8
        skip = at % 8
        while True:
            bits = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
            bits[:skip] = 0
            ones = np.flatnonzero(bits)
            if left < len(ones):
                return (byte * 8 + int(ones[left]) - i << self.low_bits) | int(self._low(i, i + 1)[0])
            left -= len(ones)
            byte, skip = byte + 64, 0

    def decode(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little")) - np.arange(self.n)
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self._low(0, self.n)

    def parts(self) -> dict[str, np.ndarray]:
        return {"high": self.high, "low": self.low, "samples": self.samples}


def write_shard(stream, documents, id_width: int = 2) -> dict:
    """Write (document id or None, ids) pairs, given in ascending order of id."""
    kind = np.dtype("<u2" if id_width == 2 else "<u4")
    stream.write(MAGIC)
    ids_seen, bounds = [], [0]
    n_null = 0
    for doc_id, ids in documents:
        if len(ids) and int(ids.max()) > np.iinfo(kind).max:
            raise ValueError(f"an id does not fit {kind.itemsize} bytes")
        stream.write(ids.astype(kind).tobytes())
        bounds.append(bounds[-1] + len(ids))
        if doc_id is None:
            n_null += 1
        else:
            ids_seen.append(doc_id)
    base = ids_seen[0] if ids_seen else 0
    above = (np.array(ids_seen, np.int64).view(np.uint64) - np.int64(base).view(np.uint64)) if ids_seen else np.zeros(0, np.uint64)
    at = len(MAGIC) + bounds[-1] * kind.itemsize
    footer: dict = {"id_width": kind.itemsize, "n_docs": len(bounds) - 1, "n_null": n_null, "n_ids": bounds[-1], "base": int(base)}
    for name, seq in (("bounds", EliasFano.encode(np.array(bounds, np.uint64))), ("doc_ids", EliasFano.encode(above))):
        footer[name] = {"n": seq.n, "low_bits": seq.low_bits}
        for part, data in seq.parts().items():
            raw = data.astype(data.dtype.newbyteorder("<")).tobytes()
            stream.write(raw)
            footer[name][part] = [at, len(raw), data.dtype.str]
            at += len(raw)
    raw = json.dumps(footer).encode()
    stream.write(raw + len(raw).to_bytes(8, "little") + MAGIC)
    return footer


class Shard:
    """Reads a shard from a seekable file: ``offset(i)``, ``ids(i)``, ``scan()``."""

    def __init__(self, file):
        self._file = file
        size = file.size() if callable(getattr(file, "size", None)) else file.seek(0, 2)
        file.seek(size - 16)
        tail = file.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token shard")
        n = int.from_bytes(tail[:8], "little")
        file.seek(size - 16 - n)
        self.footer = json.loads(file.read(n))
        self.n_docs = self.footer["n_docs"]
        self._kind = np.dtype("<u2" if self.footer["id_width"] == 2 else "<u4")
        self._bounds, self._doc_ids = (self._sequence(self.footer[k]) for k in ("bounds", "doc_ids"))

    def _sequence(self, about: dict) -> EliasFano:
        def part(name):
            at, n, kind = about[name]
            self._file.seek(at)
            return np.frombuffer(self._file.read(n), kind)

        return EliasFano(about["n"], about["low_bits"], part("high"), part("low"), part("samples"))

    def offset(self, i: int) -> int:
        return self._bounds.select(i)

    def read_ids(self, lo: int, hi: int) -> np.ndarray:
        self._file.seek(len(MAGIC) + lo * self._kind.itemsize)
        return np.frombuffer(self._file.read((hi - lo) * self._kind.itemsize), self._kind).astype("<u4")

    def ids(self, i: int) -> np.ndarray:
        return self.read_ids(self.offset(i), self.offset(i + 1))

    def doc_id(self, i: int) -> int | None:
        n = self.footer["n_null"]
        return None if i < n else _signed(self._doc_ids.select(i - n) + self.footer["base"])

    def scan(self):
        """Yields (document id, start, ids) in order, reading about ``_SLICE`` ids at a time."""
        bounds = self._bounds.decode().astype(np.int64)
        doc_ids = (self._doc_ids.decode() + np.int64(self.footer["base"]).view(np.uint64)).view(np.int64)
        n_null, i = self.footer["n_null"], 0
        while i < self.n_docs:
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + _SLICE, "right")) - 1)
            held = self.read_ids(int(bounds[i]), int(bounds[j]))
            for k in range(i, j):
                yield (None if k < n_null else int(doc_ids[k - n_null])), int(bounds[k]), held[bounds[k] - bounds[i] : bounds[k + 1] - bounds[i]]
            i = j


def _signed(value: int) -> int:
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def write_token_shards(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shards: int | None = None, path: str | None = None) -> DataFrame:
    """Encode ``docs`` and write them in ascending order of id; returns the manifest.

    Manifest: shard int, file string, n_docs long, n_ids long. Rows are dealt by
    ranges of the id, so shard numbers follow the ids. A task writes under a name
    of its own and only a finished attempt's file reaches the manifest, so lost
    executors and repeated attempts do no harm.
    """
    from pyspark import TaskContext

    spark = docs.sparkSession
    path = path or fresh_path(spark, "token-shards")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches):
        from pyarrow import fs

        encoder, doc_count = UnitEncoder(tokenizer_path), 0

        def documents():
            nonlocal doc_count
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for i, found in encode_documents(encoder, batch.column(1), end_id):
                    doc_count += 1
                    yield ids[i], found

        part = TaskContext.get().partitionId()
        store, folder = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        store.create_dir(folder, recursive=True)
        name = f"shard-{part:06d}-{uuid.uuid4().hex}.eft"
        with store.open_output_stream(f"{folder}/{name}", buffer_size=1 << 20) as stream:
            footer = write_shard(stream, documents())
        if not footer["n_docs"]:
            store.delete_file(f"{folder}/{name}")
            return
        yield pa.RecordBatch.from_pydict({"shard": pa.array([part], pa.int32()), "file": [f"{path}/{name}"], "n_docs": pa.array([footer["n_docs"]], pa.int64()), "n_ids": pa.array([footer["n_ids"]], pa.int64())})

    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange(shards, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    )
    return materialize(ordered.mapInArrow(write, "shard int, file string, n_docs long, n_ids long"), "token-manifest")


def read_token_shards(manifest: DataFrame) -> DataFrame:
    """One row per document of the shards: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it, over all shards. The
    driver sees one small row per shard, to add up where each begins.
    """
    spark = manifest.sparkSession
    rows, base = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["shard"]):
        rows.append((r["shard"], r["file"], base))
        base += r["n_ids"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)

    def read(batches):
        from pyarrow import fs

        for batch in batches:
            for file, first in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(file) if "://" in file else (fs.LocalFileSystem(), file)
                with store.open_input_file(name) as stream:
                    found = [(doc_id, first + start, len(ids), zlib.crc32(ids.tobytes())) for doc_id, start, ids in Shard(stream).scan()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = spark.createDataFrame(rows, "shard int, file string, first long")
    return shards.repartitionByRange(len(rows), "shard").mapInArrow(read, schema)
