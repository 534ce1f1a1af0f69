"""Operator 2: token ids in a bit-plane shuffled binary format.

Documents are range-partitioned by doc_id, so that shard after shard holds them in ascending order; each task encodes
its documents and streams one shard file. In a shard, ids are cut into blocks of BLOCK ids; a block is transposed into
PLANES bit planes (plane k holds bit k of each id), every plane is compressed with zstandard, all-zero planes are left
out, and the file ends with two indexes and a fixed trailer:

    magic "SWBP1\\0\\0\\0" | planes of block 0 | planes of block 1 | ... | block index | document index | trailer
    block index: per block, PLANES unsigned 32-bit lengths (0: the plane is zero) after an unsigned 64-bit file offset
    document index: per document, doc_id (signed 64) | number of ids (unsigned 64), zstandard-compressed
    trailer: blocks, documents, ids, offset of the block index, offset of the document index (each unsigned 64) | magic

A file is written under a temporary name and renamed, and its name and bytes follow from the shard alone, so that a task
that runs again after a lost executor replaces it with the same file. Global offsets come from the shard trailers: the
driver holds one small row per shard (a file each, MAX_SHARDS at most: beyond that shards grow), nothing per document.
Rows are dealt by id, then by the text's hash, then by place, so that an id on very many rows becomes more shards.

Defined results: a null or empty text has only the end id; documents with a null doc_id come first; rows that repeat a
doc_id stay apart, ordered by a hash of the text; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ship, table
from .words import Encoder, WordTable, blanks

MAGIC = b"SWBP1\0\0\0"
BLOCK = 65_536
END_ID = 2
NULL_ID = -(2**63)
SHARD_BYTES, MAX_SHARDS = 16 << 20, 50_000
#: Schemes of Hadoop's stores that pyarrow knows by another name.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}
_tables: dict[str, WordTable] = {}


def split_planes(ids: np.ndarray) -> list[bytes]:
    """The 32 bit planes of unsigned 32-bit ids, lowest first; empty for a plane that is all zero."""
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    bits = np.unpackbits(ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width), axis=1, bitorder="little")
    planes = [row.tobytes() for row in np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")]
    return [p if p.count(0) != len(p) else b"" for p in planes] + [b""] * (32 - 8 * width)


def join_planes(planes: list[bytes | None], n: int) -> np.ndarray:
    width = 4 if any(p is not None for p in planes[16:]) else 2
    rows = np.zeros((8 * width, -(-n // 8)), np.uint8)
    for k, p in enumerate(planes):
        if p is not None:
            rows[k] = np.frombuffer(p, np.uint8)
    bits = np.unpackbits(rows, axis=1, count=n, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(f"<u{width}").reshape(-1).astype("<u4")


class ShardWriter:
    def __init__(self, out: io.RawIOBase):
        self.out, self.zip = out, zstandard.ZstdCompressor(level=3)
        self.out.write(MAGIC)
        self.at, self.held, self.n_held, self.n_ids = len(MAGIC), [], 0, 0
        self.blocks: list[bytes] = []
        self.docs: list[np.ndarray] = []

    def add(self, doc_ids: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(np.stack([doc_ids.astype("<i8"), lens.astype("<i8")], axis=1))
        self.held.append(ids.astype("<u4"))
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= BLOCK:
            flat = np.concatenate(self.held)
            whole = len(flat) // BLOCK * BLOCK
            for i in range(0, whole, BLOCK):
                self.block(flat[i : i + BLOCK])
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def block(self, ids: np.ndarray) -> None:
        packed = [self.zip.compress(p) if p else b"" for p in split_planes(ids)]
        self.blocks.append(struct.pack("<Q32I", self.at, *map(len, packed)))
        for p in packed:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.n_held:
            self.block(np.concatenate(self.held))
        index, docs = b"".join(self.blocks), np.concatenate(self.docs).tobytes() if self.docs else b""
        docs_at = self.at + len(index)
        self.out.write(index + self.zip.compress(docs))
        self.out.write(struct.pack("<5Q", len(self.blocks), len(docs) // 16, self.n_ids, self.at, docs_at) + MAGIC)


class ShardReader:
    """Reads a shard by its indexes; blocks are decoded one at a time."""

    def __init__(self, f):
        self.f, self.unzip = f, zstandard.ZstdDecompressor()
        f.seek(0, 2)
        end = f.tell()
        f.seek(end - 48)
        tail = f.read(48)
        if tail[-8:] != MAGIC:
            raise ValueError("not a token shard")
        self.n_blocks, self.n_docs, self.n_ids, self.index_at, docs_at = struct.unpack("<5Q", tail[:40])
        f.seek(self.index_at)
        self.index = [struct.unpack("<Q32I", f.read(136)) for _ in range(self.n_blocks)]
        f.seek(docs_at)
        self.docs = np.frombuffer(self.unzip.decompress(f.read(end - 48 - docs_at)), "<i8").reshape(-1, 2)

    def block(self, k: int) -> np.ndarray:
        at, *lens = self.index[k]
        self.f.seek(at)
        raw = self.f.read(sum(lens))
        planes, i = [], 0
        for n in lens:
            planes.append(self.unzip.decompress(raw[i : i + n]) if n else None)
            i += n
        return join_planes(planes, min(BLOCK, self.n_ids - k * BLOCK))

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(doc_id, first id's place in the shard, ids), in order; holds one document and one block."""
        held, k, start = np.zeros(0, "<u4"), 0, 0
        for doc_id, n in self.docs.tolist():
            # A document within the block at hand is a view of it; only one that goes on beyond is put together.
            if n > len(held):
                parts, got = [held], len(held)
                while got < n:
                    parts.append(self.block(k))
                    got, k = got + len(parts[-1]), k + 1
                rest = parts[-1][len(parts[-1]) - (got - n) :]
                parts[-1] = parts[-1][: len(parts[-1]) - len(rest)]
                ids = np.concatenate(parts)
            else:
                ids, rest = held[:n], held[n:]
            yield doc_id, start, ids
            held, start = rest, start + n


def file_system(uri: str):
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    return fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + colon + rest)


def encode_texts(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """ids of all texts, END_ID after each, and how many each text has with it."""
    if path not in _tables:
        _tables[path] = WordTable(Encoder(path).ids, np.uint32)
    words = [blanks(t) if t else [] for t in texts]
    known = _tables[path]
    at = known.look_up([w for ws in words for w in ws])
    ids, lens = known.gather(at)
    ends = np.concatenate([[0], np.cumsum(lens)])[np.cumsum([0, *map(len, words)])]
    ids = np.insert(ids, ends[1:], END_ID)
    return ids, np.diff(ends) + 1


def slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, or one text."""
    part = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _write(base: str, path: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        shard = task.partitionId()
        disk, folder = file_system(base)
        name, temp = f"{folder}/{shard:06d}.swbp", f"{folder}/.{shard:06d}-{task.taskAttemptId()}-{uuid.uuid4().hex}"
        out = None
        for batch in batches:
            for part in slices(batch):
                if out is None:
                    disk.create_dir(folder, recursive=True)
                    out = disk.open_output_stream(temp)
                    writer = ShardWriter(out)
                ids, lens = encode_texts(part["text"].to_pylist(), path)
                writer.add(part["doc_id"].fill_null(NULL_ID).to_numpy(), lens, ids)
        if out is not None:
            writer.close()
            out.close()
            disk.move(temp, name)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [f"{base}/{shard:06d}.swbp"], "n_docs": pa.array([sum(map(len, writer.docs))], pa.int64()), "n_ids": pa.array([writer.n_ids], pa.int64())})

    return write


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            disk, path = file_system(row["file"])
            with disk.open_input_file(path) as f:
                rows = []
                for doc_id, start, ids in ShardReader(f).documents():
                    rows.append((None if doc_id == NULL_ID else doc_id, row["start"] + start, len(ids), zlib.crc32(np.ascontiguousarray(ids))))
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, path: str, base: str, shard_bytes: int = SHARD_BYTES, max_shards: int = MAX_SHARDS) -> DataFrame:
    """Writes the shards of (doc_id, text) under the URI base; a table of (shard, file, n_docs, n_ids, start)."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "token-shards")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = min(max_shards, max(1, -(-total // shard_bytes)))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h").asc_nulls_first(), F.col("row").asc()]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    made = scratch.save(dealt.mapInArrow(_write(base, path), "shard int, file string, n_docs long, n_ids long"))
    rows, n = [], 0
    for r in sorted(made.collect(), key=lambda r: r["shard"]):
        rows.append((r["shard"], r["file"], r["n_docs"], r["n_ids"], n))
        n += r["n_ids"]
    return spark.createDataFrame(rows, "shard int, file string, n_docs long, n_ids long, start long")


def read_tokens(shards: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    n = max(1, shards.count())
    return shards.select("file", "start").repartition(n).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    base = Scratch(spark, "tokens").base
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), base))
