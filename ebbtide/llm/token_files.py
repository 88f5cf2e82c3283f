"""Token ids in binary files: one zstandard frame per document, with a dictionary shared by all.

File: ``TOKZ``, version, 32-byte SHA-256 of the dictionary; the frames; an index of fixed-size entries
(has an id, id, offset and size of the frame, number of tokens); number of entries and ``TOKZ``.
A frame holds a document's ids as little-endian unsigned 32-bit integers. The dictionary lies beside
the files, named by its hash. A reader that wants one document reads the index and one frame.

The dictionary is trained on the ids of at most ``SAMPLE`` documents of at most ``SAMPLE_CHARS``
characters, those of lowest hash among those below a bound that follows from the number of rows; it changes sizes, never contents. Files follow ascending ``doc_id``,
null first, repeated ids in the order of their texts. A null text has the end id alone. An empty table
gives no file and an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbtide.llm.shard_files import ShardFile, committed, in_shards, written
from ebbtide.llm.shared import filesystem, new_folder, slices, whole_text
from ebbtide.llm.word_encoding import ROWS, encoder

MAGIC, VERSION, SUFFIX = b"TOKZ", 1, ".tok"
HEADER, FOOTER = "<4sI32s", "<Q4s"
FOOTER_SIZE = struct.calcsize(FOOTER)
ENTRY = np.dtype([("has_id", "u1"), ("doc_id", "<i8"), ("offset", "<u8"), ("size", "<u8"), ("tokens", "<u8")])
SAMPLE, SAMPLE_CHARS, DICTIONARY_BYTES, LEVEL = 1000, 8000, 112_640, 3
END = np.uint32(2).tobytes()
#: Documents and tokens that a reader unpacks at a time; a longer document is read alone.
READ_ROWS, READ_TOKENS = 512, 1 << 21


def trained_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """From the bounded sample; raw sample bytes where there is too little to train on."""
    drawn = F.xxhash64(F.col("doc_id").cast("long"), "text")
    # about four times the sample passes, so that tasks need not send a sample each
    most = min(4 * SAMPLE * 2**64 // max(docs.count(), 1), 2**64 - 1) - 2**63
    short = docs.select(whole_text().alias("text"), "doc_id").filter(F.length("text").between(1, SAMPLE_CHARS) & (drawn <= most))
    texts = [r.text for r in short.orderBy(drawn, "text").select("text").limit(SAMPLE).collect()]
    serialized = [ids + END for ids in encoder(tokenizer, False).encode_all(texts)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, serialized).as_bytes()
    except zstandard.ZstdError:
        return b"".join(serialized)[-DICTIONARY_BYTES:]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, shard_chars: int = 32 << 20) -> DataFrame:
    """Encode every whole text and write the files; returns their manifest."""
    data = trained_dictionary(docs, tokenizer)
    digest = hashlib.sha256(data).digest()
    fs, base = filesystem(folder)
    fs.create_dir(base)
    with fs.open_output_stream(f"{base}/{digest.hex()}.dictionary") as out:
        out.write(data)
    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    rows, shards = in_shards(texts, "doc_id", F.length("text") + 16, shard_chars)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        words = encoder(tokenizer, False)
        encode = words.encode_all
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data)).compress
        file, index = None, []

        def finish() -> dict:
            file.write(np.array(index, ENTRY).tobytes())
            file.write(struct.pack(FOOTER, len(index), MAGIC))
            return file.close()

        for batch in slices(batches, ROWS):
            doc_ids, texts, shards = (c.to_pylist() for c in batch.columns)
            for doc_id, ids, shard in zip(doc_ids, encode(texts), shards):
                if file is None or file.shard != shard:
                    if file:
                        yield finish()
                    file, index = ShardFile(folder, shard, 0), []
                    file.write(struct.pack(HEADER, MAGIC, VERSION, digest))
                ids += END
                frame = pack(ids)
                index.append((doc_id is not None, doc_id or 0, file.bytes, len(frame), len(ids) // 4))
                file.write(frame)
                file.records += 1
                file.items += len(ids) // 4
        if file:
            yield finish()
        # an executor has more workers than tasks, and those that wait would keep their words
        words.forget()
        pa.default_memory_pool().release_unused()

    return committed(written(rows, shards, ["doc_id", "text"], write), folder, SUFFIX)


def opened(file: pa.NativeFile) -> tuple[bytes, np.ndarray]:
    """The dictionary's hash and the index of a file; no frame is read."""
    size, head = file.size(), struct.calcsize(HEADER)
    magic, version, digest = struct.unpack(HEADER, file.read_at(head, 0))
    entries, end = struct.unpack(FOOTER, file.read_at(FOOTER_SIZE, size - FOOTER_SIZE))
    if (magic, version, end) != (MAGIC, VERSION, MAGIC):
        raise ValueError("not a token file of this version")
    return digest, np.frombuffer(file.read_at(entries * ENTRY.itemsize, size - FOOTER_SIZE - entries * ENTRY.itemsize), ENTRY)


def dictionary(folder: str, digest: bytes) -> zstandard.ZstdCompressionDict:
    fs, base = filesystem(folder)
    with fs.open_input_stream(f"{base}/{digest.hex()}.dictionary") as stream:
        data = stream.read()
    if hashlib.sha256(data).digest() != digest:
        raise ValueError("the dictionary is not the one that the files were written with")
    return zstandard.ZstdCompressionDict(data)


def read_document(folder: str, name: str, doc_id: int) -> np.ndarray:
    """The ids of one document of one file: reads header, index and that frame only."""
    fs, base = filesystem(folder)
    with fs.open_input_file(f"{base}/{name}") as file:
        digest, index = opened(file)
        entry = index[np.flatnonzero((index["doc_id"] == doc_id) & (index["has_id"] == 1))[0]]
        frame = file.read_at(int(entry["size"]), int(entry["offset"]))
    return np.frombuffer(zstandard.ZstdDecompressor(dict_data=dictionary(folder, digest)).decompress(frame), "<u4")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary) of every document, from the files."""
    # one row per file, not per document
    before = Window.orderBy("shard", "number").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("name", F.coalesce(F.sum("items").over(before), F.lit(0)).alias("file_start"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task reads a file's index, and then so many frames at a time: never a whole file."""
        fs, base = filesystem(folder)
        for name, file_start in ((r.column(0)[0].as_py(), r.column(1)[0].as_py()) for r in slices(batches, 1)):
            with fs.open_input_file(f"{base}/{name}") as file:
                digest, index = opened(file)
                unpack = zstandard.ZstdDecompressor(dict_data=dictionary(folder, digest)).decompress
                ends = np.cumsum(index["tokens"].astype(np.int64))
                at = 0
                while at < len(index):
                    to = np.searchsorted(ends, (ends[at - 1] if at else 0) + READ_TOKENS, "right")
                    part = index[at:min(max(to, at + 1), at + READ_ROWS)]
                    first = int(part["offset"][0])
                    frames = memoryview(file.read_at(int(part["offset"][-1] + part["size"][-1]) - first, first))
                    cuts = zip((part["offset"].astype(np.int64) - first).tolist(), part["size"].tolist())
                    tokens = part["tokens"].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(part["doc_id"], mask=part["has_id"] == 0), pa.array(file_start + ends[at:at + len(part)] - tokens),
                        pa.array(tokens), pa.array([unpack(frames[o:o + s]) for o, s in cuts], pa.binary()),
                    ], names=["doc_id", "start", "n_tokens", "ids"])
                    at += len(part)

    files = files.repartition(max(manifest.count(), 1))
    return files.mapInArrow(parse, "doc_id long, start long, n_tokens long, ids binary")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the files into a new folder and read them back."""
    folder = new_folder(spark, "tokens")
    return read_token_files(write_token_files(docs, folder, tokenizer), folder)
