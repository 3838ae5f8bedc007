"""Token ids in binary files of compressed planes.

Documents are range-partitioned by id and sorted; each partition becomes one
file.  Ids (unsigned 32 bit) are cut into blocks of a fixed number, a block is
transposed into byte planes (all low bytes, then all second bytes, ..) or bit
planes, and each plane is compressed with zstandard on its own.

File layout: ``MAGIC``; the compressed planes of block 0, 1, ..; the chunk
index as JSON {planes, n_ids, chunks: [[offset, n_ids, [plane sizes]], ..]};
its length as 8 bytes, little endian; ``MAGIC``.  Beside the files lies a
Parquet table ``docs`` (shard, doc_no, id, start, n_tokens), start counted
from the beginning of its file, so any document is read by seeking to its
blocks.

A file is written under a name of its own attempt and then renamed, so a task
that runs again after a lost executor, or twice, leaves the same whole file.
The folder must be one that all executors share.

Defined cases: a null text is an empty document (its end id alone); null ids
come first; rows of equal id follow each other in text order; an empty table
gives no file; columns other than id and text are not stored.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.bpe import SLICE_ROWS, WORD, PieceCache, byte_alphabet, pack_ids, slices
from foldwise.llm.common import require

MAGIC = b"FWPLANE1"
TEXT_BYTES = 4 << 20        # of texts encoded together
FILE_BYTES = 128 << 20      # text of a file, where the shuffle's partitions alone would hold more
BLOCK_IDS = 65_536
LEVEL = 3

_WORKER: dict = {}


def library_cache(path: str) -> PieceCache:
    """Encoder of whole texts with the tokenizers library, one per worker; equal pieces are encoded once."""
    if path not in _WORKER:
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()

        word_ids = tok.model.tokenize
        letters = {i: c for i, c in enumerate(byte_alphabet())}

        def encode(pieces: list[str]) -> list[bytes]:
            # a word goes straight to the library's model, what needs its pattern through the whole tokenizer
            out = [pack_ids([t.id for t in word_ids(p.encode().decode("latin-1").translate(letters))])
                   if WORD.match(p) else b"" for p in pieces]
            others = [i for i, ids in enumerate(out) if not ids and pieces[i]]
            for i, e in zip(others, tok.encode_batch_fast([pieces[i] for i in others], add_special_tokens=False), strict=True):
                out[i] = pack_ids(e.ids)
            return out

        _WORKER[path] = PieceCache(encode)
    return _WORKER[path]


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == "bit":
        return [np.packbits(p).tobytes() for p in np.unpackbits(rows, axis=1, bitorder="little").T]
    return [p.tobytes() for p in rows.T]


def from_planes(parts: list[bytes], n: int, planes: str) -> np.ndarray:
    if planes == "bit":
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in parts], axis=1)
        return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()
    return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in parts], axis=1)).view("<u4").ravel()


def _file_system(folder: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder)


class PlaneWriter:
    """Writes one file, block by block; it gets its name when it is whole."""

    def __init__(self, folder: str, name: str, planes: str = "byte", block_ids: int = BLOCK_IDS, level: int = LEVEL):
        import zstandard
        self.fs, root = _file_system(folder)
        self.final, self.draft = f"{root}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}"
        self.fs.create_dir(root, recursive=True)
        self.out = self.fs.open_output_stream(self.draft)
        self.out.write(MAGIC)
        self.at, self.n_ids, self.chunks = len(MAGIC), 0, []
        self.planes, self.block_ids, self.pack = planes, block_ids, zstandard.ZstdCompressor(level=level).compress
        self.waiting, self.n_waiting = [], 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block_ids:
            every = np.concatenate(self.waiting)
            whole = self.n_waiting - self.n_waiting % self.block_ids
            for i in range(0, whole, self.block_ids):
                self._block(every[i:i + self.block_ids])
            self.waiting, self.n_waiting = [every[whole:].copy()], self.n_waiting - whole

    def _block(self, ids: np.ndarray) -> None:
        parts = [self.pack(p) for p in to_planes(ids, self.planes)]
        self.chunks.append([self.at, len(ids), [len(p) for p in parts]])
        for p in parts:
            self.out.write(p)
            self.at += len(p)
        self.n_ids += len(ids)

    def close(self) -> None:
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        index = json.dumps({"planes": self.planes, "n_ids": self.n_ids, "chunks": self.chunks}).encode()
        self.out.write(index + len(index).to_bytes(8, "little") + MAGIC)
        self.out.close()
        self.fs.move(self.draft, self.final)


class PlaneReader:
    """Random access to the ids of one file; holds one block."""

    def __init__(self, folder: str, name: str):
        import zstandard
        fs, root = _file_system(folder)
        self.file = fs.open_input_file(f"{root}/{name}")
        size, tail = self.file.size(), 8 + len(MAGIC)
        end = self.file.read_at(tail, size - tail)
        n = int.from_bytes(end[:8], "little")
        if end[8:] != MAGIC:
            raise ValueError(f"{name} is not a whole plane file")
        spec = json.loads(self.file.read_at(n, size - tail - n))
        self.planes, self.n_ids, self.chunks = spec["planes"], spec["n_ids"], spec["chunks"]
        self.starts = np.cumsum([0] + [c[1] for c in self.chunks])
        self.unpack = zstandard.ZstdDecompressor().decompress
        self.held, self.block = -1, None

    def _load(self, k: int) -> np.ndarray:
        if k != self.held:
            at, n, sizes = self.chunks[k]
            raw, parts = self.file.read_at(sum(sizes), at), []
            for s in sizes:
                parts.append(self.unpack(raw[:s]))
                raw = raw[s:]
            self.held, self.block = k, from_planes(parts, n, self.planes)
        return self.block

    def read(self, start: int, n: int) -> np.ndarray:
        out, k = [], int(np.searchsorted(self.starts, start, side="right")) - 1
        while n > 0:
            part = self._load(k)[start - self.starts[k]:][:n]
            out.append(part)
            start, n, k = start + len(part), n - len(part), k + 1
        return np.concatenate(out) if out else np.empty(0, "<u4")


def shard_name(shard: int) -> str:
    return f"ids-{shard:06d}.planes"


def write(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
          end_id: int = 2, files: int | None = None, planes: str = "byte", block_ids: int = BLOCK_IDS) -> None:
    """Encode all texts and write them in ascending id order, ``end_id`` after each."""
    import pyarrow as pa
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    if not files:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    # the texts of one id, which may be many, are dealt by their beginnings
    first = F.col("id").asc_nulls_first()
    rows = rows.repartitionByRange(files, first, F.substring("text", 1, 32)).sortWithinPartitions(first, "text")

    def run(batches):
        from pyspark import TaskContext
        shard = TaskContext.get().partitionId()
        cache, out, doc_no = library_cache(tokenizer_path), None, 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                out = out or PlaneWriter(folder, shard_name(shard), planes, block_ids)
                found = [b + end for b in cache([t or "" for t in part.column(1).to_pylist()])]
                sizes = np.array([len(b) // 4 for b in found], np.int64)
                first = out.n_ids + out.n_waiting
                out.add(np.frombuffer(b"".join(found), "<u4"))
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * n, pa.int32()), pa.array(range(doc_no, doc_no + n), pa.int64()), part.column(0),
                     pa.array(first + np.cumsum(sizes) - sizes), pa.array(sizes)],
                    ["shard", "doc_no", "id", "start", "n_tokens"])
                doc_no += n
        if out:
            out.close()

    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("doc_no", T.LongType()),
                           T.StructField("id", rows.schema["id"].dataType),
                           T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType())])
    rows.mapInArrow(run, schema).write.mode("overwrite").parquet(f"{folder}/docs")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids) of every document, from the files; start counts
    the ids of all documents before it, ids is binary (little-endian, 32 bit)."""
    import pyarrow as pa
    docs = spark.read.parquet(f"{folder}/docs")
    in_order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)   # one row per file
    before = docs.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("before"))
    docs = docs.join(before, "shard").repartitionByRange("shard").sortWithinPartitions("shard", "start", "doc_no")
    docs = docs.select("shard", "start", "id", (F.col("before") + F.col("start")).alias("total"), "n_tokens")

    def run(batches):
        held, file = None, None
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(i, SLICE_ROWS)
                found = []
                for shard, start, n in zip(*(part.column(k).to_pylist() for k in (0, 1, 4)), strict=True):
                    if shard != held:
                        held, file = shard, PlaneReader(folder, shard_name(shard))
                    found.append(file.read(start, n).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), part.column(4), pa.array(found, pa.binary())],
                                                 ["id", "start", "n_tokens", "ids"])

    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return docs.mapInArrow(run, schema)
