"""Token ids in binary files: independent zstandard frames and a trailing seek table.

One file (shard) for each range of doc_id. Layout, all integers little-endian:

    frame*           zstandard frames of at most FRAME_IDS ids (unsigned 32-bit) each
    skippable frame  0x184D2A50: document index: number of documents, then zstandard of
                     doc_id int64[], has_id uint8[], n_tokens int64[]; before it the xxh64 of that
    skippable frame  0x184D2A5E: seek table: for each frame its compressed size, its plain size and
                     the low 32 bits of the xxh64 of its plain bytes; then the number of frames,
                     a descriptor with the checksum bit, and 0x8F92EAB1

So any zstandard decoder reads the ids of a file, and a reader of a few documents gets the index
and the table from the end of the file and decompresses only the frames that hold them, checking
each one's checksum.

Writing: documents are range-partitioned by id (then text), sorted within the partition, encoded
and written by the task that holds them, under a name of its own that is renamed when complete;
a lost or repeated task leaves the same file. The driver sees one manifest row for each shard.
Files go through ``pyarrow.fs`` to the shared folder, so the folder may be on any file system
that pyarrow knows. Memory: one chunk of texts, one open frame, and the index of the shard.

Results: null text is empty (only the end id); texts are encoded whole; ids null come first;
equal ids are ordered by text; each input row is one document; an empty table gives no shards and
an empty table on reading; extra columns are not read.
"""

from __future__ import annotations

import struct
import uuid
from array import array
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendspark.llm import pieces, vocab
from trendspark.llm.common import chunks, held, release
from trendspark.session import scratch_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
FRAME_IDS = 1 << 16
INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
CHUNK_CHARS, KNOWN = 1_500_000, 300_000
#: The letter that stands for each byte in the vocabulary.
LETTERS = {byte: letter for letter, byte in vocab.byte_letters().items()}


class FrameWriter:
    """Writes one shard to an open stream."""

    def __init__(self, out, frame_ids: int = FRAME_IDS):
        import zstandard

        self.out, self.frame_bytes = out, 4 * frame_ids
        self.compress = zstandard.ZstdCompressor(level=3).compress
        self.open, self.size = [], 0
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        at = 0
        while at < len(ids):
            part = ids[at : at + self.frame_bytes - self.size]
            self.open.append(part)
            self.size += len(part)
            at += len(part)
            if self.size == self.frame_bytes:
                self._flush()

    def _flush(self) -> None:
        import xxhash

        plain = b"".join(self.open)
        packed = self.compress(plain)
        self.out.write(packed)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.open, self.size = [], 0

    def close(self) -> None:
        import xxhash

        if self.size:
            self._flush()
        arrays = np.array([i or 0 for i in self.ids], "<i8"), np.array([i is not None for i in self.ids], "u1"), np.array(self.counts, "<i8")
        index = self.compress(b"".join(a.tobytes() for a in arrays))
        body = struct.pack("<QQ", len(self.ids), xxhash.xxh64_intdigest(index)) + index
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(body)) + body)
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), CHECKSUMS, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(entries) + len(footer)) + entries + footer)


class FrameReader:
    """Reads documents of one shard from a seekable file."""

    def __init__(self, file, size: int):
        import xxhash
        import zstandard

        self.file = file
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        table = size - 9 - 12 * n - 8
        self.frames = np.frombuffer(self._at(table + 8, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.begin = np.append(0, np.cumsum(self.frames[:, 0]))
        self.plain = np.append(0, np.cumsum(self.frames[:, 1]))
        at = int(self.begin[-1])
        magic, length = struct.unpack("<II", self._at(at, 8))
        body = self._at(at + 8, length)
        docs, digest = struct.unpack("<QQ", body[:16])
        if magic != INDEX_MAGIC or xxhash.xxh64_intdigest(body[16:]) != digest:
            raise ValueError("the document index is damaged")
        raw = zstandard.ZstdDecompressor().decompress(body[16:], max_output_size=17 * docs) if docs else b""
        self.ids = np.frombuffer(raw, "<i8", docs)
        self.has_id = np.frombuffer(raw, "u1", docs, 8 * docs).astype(bool)
        self.counts = np.frombuffer(raw, "<i8", docs, 9 * docs)
        self.starts = np.append(0, np.cumsum(self.counts))
        self.held: tuple[int, bytes] = (-1, b"")

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def frame(self, k: int) -> bytes:
        import xxhash
        import zstandard

        if self.held[0] != k:
            packed, plain, check = self.frames[k].tolist()
            data = zstandard.ZstdDecompressor().decompress(self._at(int(self.begin[k]), packed), max_output_size=plain)
            if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} is damaged")
            self.held = (k, data)
        return self.held[1]

    def tokens(self, k: int) -> bytes:
        """The ids of the k-th document; reads only the frames that hold them."""
        a, b = 4 * int(self.starts[k]), 4 * int(self.starts[k + 1])
        out, f = [], int(np.searchsorted(self.plain, a, "right")) - 1
        while a < b:
            data = self.frame(f)
            part = data[a - int(self.plain[f]) : b - int(self.plain[f])]
            out.append(part)
            a += len(part)
            f += 1
        return b"".join(out)


def _open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Encoder:
    """Ids of whole texts as the tokenizers library gives them; each different pre-token is
    encoded once by the library and kept in a bounded cache. A worker process has one (``encoder``),
    so that its tasks read the tokenizer's file once and share what they have learned."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known = pieces.Recent(KNOWN)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def _learn(self, words: list[str]) -> None:
        """Pre-tokens go straight to the library's model, in its letters for bytes: cutting is done."""
        tokenize, known = self.library.model.tokenize, self.known
        for w in words:
            known[w] = array("I", [t.id for t in tokenize(w.encode().decode("latin-1").translate(LETTERS))]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        plain = []
        for k, t in enumerate(texts):
            if any(s in t for s in self.special):  # a special string is one id wherever it stands
                out[k] = np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                plain.append(k)
        cut_up = pieces.Pieces([texts[k] for k in plain])
        known = self.known
        new = known.unknown(cut_up.different)
        self._learn(new)
        flat, size = cut_up.ids([known[w] for w in cut_up.different])
        packed, at = flat.astype("<u4").tobytes(), 0
        for k, n in zip(plain, size.tolist(), strict=True):
            out[k] = packed[at : at + 4 * n]
            at += 4 * n
        return out


def encoder(path: str) -> Encoder:
    return held(f"encoder of {path}", lambda: Encoder(path))


@dataclass(frozen=True)
class Shards:
    """Where the files are, and a table of them: shard, file, n_docs, n_tokens."""

    folder: str
    manifest: DataFrame


def write_frames(docs: DataFrame, folder: str | None = None, path: str | None = None, shards: int | None = None) -> Shards:
    """Encode ``docs`` (doc_id, text) into ``shards`` files (default: the session's shuffle
    partitions) under ``folder`` (default: a new one in the shared folder)."""
    spark = docs.sparkSession
    path = path or vocab.default_path(VOCABULARY)
    folder = folder or scratch_path(spark, "token-frames")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = struct.pack("<I", END_ID)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        own_encoder = writer = None
        shard = TaskContext.get().partitionId()
        store, base = _open_fs(folder)
        name, own = f"shard-{shard:06d}.zst", f".shard-{shard:06d}-{uuid.uuid4().hex}"
        out = None
        n_tokens = 0
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            if texts and writer is None:
                store.create_dir(base, recursive=True)
                own_encoder, out = encoder(path), store.open_output_stream(f"{base}/{own}")
                writer = FrameWriter(out)
            for a, b in chunks(texts, CHUNK_CHARS):
                for i, packed in zip(ids[a:b], own_encoder.encode(texts[a:b]), strict=True):
                    writer.add(i, packed + end)
                    n_tokens += len(packed) // 4 + 1
        if writer is not None:
            writer.close()
            out.close()
            release()
            store.move(f"{base}/{own}", f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [name], "n_docs": [len(writer.ids)], "n_tokens": [n_tokens]}, schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(shards, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(run, "shard int, file string, n_docs long, n_tokens long").write.parquet(f"{folder}/manifest")
    return Shards(folder, read_manifest(spark, folder))


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("shard int, file string, n_docs long, n_tokens long").parquet(f"{folder}/manifest")


def read_frames(found: Shards, doc_ids: list[int] | None = None, ids_too: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of all documents, or of the given ids only (then
    only their frames are decompressed). start: ids of all documents before it, over all shards."""
    folder = found.folder
    # one row for each file; sums over the files before it
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    files = found.manifest.withColumn("before", F.coalesce(before, F.lit(0)))
    wanted = None if doc_ids is None else np.array(sorted(set(doc_ids)), np.int64)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids_too

    def run(batches):
        import zlib

        import pyarrow as pa

        kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * ids_too)
        store, base = _open_fs(folder)
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                info = store.get_file_info(f"{base}/{name}")
                with store.open_input_file(info.path) as file:
                    reader = FrameReader(file, info.size)
                    take = range(len(reader.ids)) if wanted is None else np.flatnonzero(np.isin(reader.ids, wanted) & reader.has_id).tolist()
                    out, size = [], 0
                    for k in take:
                        ids = reader.tokens(k)
                        row = {"doc_id": int(reader.ids[k]) if reader.has_id[k] else None, "start": first + int(reader.starts[k]), "n_tokens": len(ids) // 4, "ids_crc32": zlib.crc32(ids)}
                        out.append(row | ({"ids": ids} if ids_too else {}))
                        size += len(ids)
                        if size > 1 << 24 or len(out) == 5000:
                            yield pa.RecordBatch.from_pylist(out, schema=kinds)
                            out, size = [], 0
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema=kinds)

    width = int(found.manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file", "before").repartition(width, "file").mapInArrow(run, schema)
