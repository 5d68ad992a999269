"""Token ids in a seekable binary format, written and read by Spark's own readers and writers.

A file is a run of independent Zstandard frames and ends in the seekable format's table. Layout:
data frames (ids as little-endian unsigned 32-bit integers; whole documents, several to a frame up to
FRAME bytes, a longer document alone), then a skippable frame with the file's index (doc_id, frame, offset
in the frame, ids) and a skippable frame with the seek table: for each data frame its compressed size,
size and checksum (low 32 bits of XXH64 of its content), then the number of frames, a descriptor byte and
the magic number. A reader needs the tail, the index and the frames of the documents it wants.

Documents are range-partitioned by doc_id and each partition writes files of at most FILE_IDS ids, or of one longer document. Spark's
text writer commits them (its line end is the format's closing magic number, so the bytes are the file and
nothing else); a lost executor's task is written again. Any store that Spark reads will do.

Where a tokenizer's steps are those of SHAPE, white space always ends a word, so a batch's distinct words are encoded once and ids
gathered by position; texts that hold an added token's letters in any case or a capital before a combining mark, and all texts of other
tokenizers, go to the library whole.

Defined cases: null text counts as empty and has the end id only; rows alike in doc_id stand in the order of
their texts, nulls first; a null doc_id sorts first; an empty table gives an empty result; extra columns are
ignored; a very long text is encoded whole and is a frame of its own.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import new_path, slices, written

FRAME = 1 << 16
FILE_IDS = 4_000_000
#: Files up to which a look-up names those it opens; beyond, the folder is read and joined.
LISTED = 10_000
MAGIC = struct.pack("<I", 0x8F92EAB1)
_SKIP_INDEX, _SKIP_SEEK = 0x184D2A51, 0x184D2A5E
_INDEX = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("frame", "<u4"), ("at", "<u4"), ("n", "<u8")])
_SEEK = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])


#: The steps of a tokenizer whose texts may be cut at white space: fixed values of the format, compared as a whole.
SHAPE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}


class Encoder:
    """Ids of texts by the tokenizers library (spec: a tokenizer's JSON), a distinct word at a time; keeps words' ids, from a batch to the next while they are fewer than `keep`."""

    def __init__(self, spec: str, keep: int = 200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.keep, self.known = keep, {}
        spec = json.loads(spec)
        added = spec.get("added_tokens") or []
        self.by_word = all(spec.get(k) == v for k, v in SHAPE.items()) and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and all(t["content"].isascii() and not t["normalized"] for t in added)
        self.added = [t["content"].lower() for t in added]
        # Words of letters that no step of the pipeline cuts, or changes but for their case, go to the model straight away; so do they before ASCII punctuation other than an apostrophe.
        letters = "[a-zÀ-ÖØ-öø-ÿ]+"
        self.plain = re.compile(letters).fullmatch
        self.tail = re.compile(rf"({letters})([!-&(-/:-@\[-`{{-~]+)").fullmatch
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.bytes = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _letters(self, word: str) -> list[int]:
        ids = self.known.get(word)
        if ids is None:
            ids = self.known[word] = [t.id for t in self.tokenizer.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.bytes))]
        return ids

    def words(self, words: list[str]) -> list:
        """The ids of each word."""
        known = self.known
        if len(known) >= self.keep:
            known.clear()
        out = list(map(known.get, words))
        tokenize, rest = self.tokenizer.model.tokenize, []
        for i, w in enumerate(words):
            if out[i] is not None:
                continue
            if w.isascii() and w.isalpha() and w.islower():
                out[i] = known[w] = [t.id for t in tokenize(w)]
            elif self.plain(w):
                out[i] = self._letters(w.lower())
            elif m := self.tail(w):
                out[i] = self._letters(m[1].lower()) + self._whole(m[2])
            else:
                rest.append(i)
        for i, ids in zip(rest, self._batch([words[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _batch(self, texts: list[str], size: int = 4096) -> Iterator[list[int]]:
        for k in range(0, len(texts), size):
            for e in self.tokenizer.encode_batch_fast(texts[k : k + size], add_special_tokens=False):
                yield e.ids

    def _whole(self, text: str) -> list[int]:
        ids = self.known.get(text)
        if ids is None:
            ids = self.known[text] = self.tokenizer.encode(text, add_special_tokens=False).ids
        return ids

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and where each text's ids end."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            return _joined([np.array(ids, np.uint32) for ids in self._batch(texts.to_pylist(), 64)])
        low = pc.ascii_lower(texts)
        # Capitals before combining marks may compose otherwise than small letters, so they are not lower-cased ahead of the library.
        held = np.asarray(pc.match_substring_regex(texts, r"[A-Z]\p{M}"))
        for token in self.added:
            held = held | np.asarray(pc.match_substring(low, token))
        if not held.any():
            return self._by_word(low)
        ids, ends = self._by_word(pc.if_else(pa.array(held), "", low))
        parts = np.split(ids, ends[:-1])
        at = np.flatnonzero(held).tolist()
        for i, own in zip(at, self._batch([texts[i].as_py() for i in at], 64), strict=True):
            parts[i] = np.array(own, np.uint32)
        return _joined(parts)

    def _by_word(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        chunks = pc.ascii_split_whitespace(texts)
        flat = chunks.flatten().dictionary_encode()
        names = flat.dictionary.to_pylist()
        table = self.words(names)
        sizes = np.fromiter(map(len, table), np.int32, len(table))
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        pool = np.fromiter(chain.from_iterable(table), np.uint32, int(starts[-1]))
        del names, table
        codes = np.asarray(flat.indices) if len(flat) else np.zeros(0, np.int32)
        n = sizes[codes] if len(codes) else np.zeros(0, np.int32)
        ends = np.cumsum(n, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total, dtype=np.int64 if total >= 2**31 else np.int32)
        if total:
            at += np.repeat((starts[codes] - (ends - n)).astype(at.dtype), n)
        words = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(chunks)).astype(np.int64))])
        by_word = np.concatenate([[0], ends])
        return pool[at], by_word[words[1:]]


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, np.uint32), *parts]), np.cumsum([len(x) for x in parts], dtype=np.int64)


class FileMaker:
    """Builds one file: documents in, bytes without the closing magic number out."""

    def __init__(self, level: int = 1):
        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames, self.seek, self.index, self.open, self.held, self.ids = [], [], [], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        data = ids.astype("<u4").tobytes()
        if self.open and self.held + len(data) > FRAME:
            self._close()
        self.index.append((doc_id or 0, doc_id is not None, len(self.frames), self.held // 4, len(ids)))
        self.open.append(data)
        self.held += len(data)
        self.ids += len(ids)

    def _close(self) -> None:
        data = b"".join(self.open)
        packed = self.packer.compress(data)
        self.frames.append(packed)
        self.seek.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.open, self.held = [], 0

    def done(self) -> bytes:
        if self.open:
            self._close()
        index = self.packer.compress(np.array(self.index, _INDEX).tobytes())
        table = np.array(self.seek, _SEEK).tobytes()
        seek = table + struct.pack("<IB", len(self.seek), 0x80)
        return b"".join([*self.frames, struct.pack("<II", _SKIP_INDEX, len(index)), index, struct.pack("<II", _SKIP_SEEK, len(seek) + 4), seek])


class FileReader:
    """Reads a file's index and, frame by frame as asked, its documents; checks every frame that it opens."""

    def __init__(self, data: bytes):
        if data[-4:] != MAGIC:
            raise ValueError("not a seekable file")
        count = struct.unpack_from("<I", data, len(data) - 9)[0]
        at = len(data) - 9 - count * _SEEK.itemsize
        self.seek = np.frombuffer(data, _SEEK, count, at)
        self.starts = np.concatenate([[0], np.cumsum(self.seek["packed"].astype(np.int64))])
        skip, size = struct.unpack_from("<II", data, int(self.starts[-1]))
        if skip != _SKIP_INDEX:
            raise ValueError("no index")
        begin = int(self.starts[-1]) + 8
        self.data, self.unpacker = data, zstandard.ZstdDecompressor()
        self.index = np.frombuffer(self.unpacker.decompress(data[begin : begin + size]), _INDEX)
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            raw = self.unpacker.decompress(self.data[int(self.starts[k]) : int(self.starts[k + 1])])
            if len(raw) != self.seek["size"][k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.seek["check"][k]:
                raise ValueError(f"frame {k} is damaged")
            self.last = (k, raw)
        return self.last[1]

    def document(self, i: int) -> bytes:
        """The i-th document's ids, little-endian unsigned 32-bit."""
        entry = self.index[i]
        at = 4 * int(entry["at"])
        return self.frame(int(entry["frame"]))[at : at + 4 * int(entry["n"])]


def write(docs: DataFrame, vocabulary: str, path: str, end_id: int = 2) -> None:
    """Encode every text, append end_id, write files in ascending doc_id order under path.

    Each file's name holds its place: files sort by partition, then by number within it.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(_files(docs), "doc_id").sortWithinPartitions("doc_id", "text")

    spec = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, maker = Encoder(spec.value), FileMaker()
        end = np.array([end_id], np.uint32)
        for batch in slices(batches, "text", 8 << 20):
            ids, ends = encoder.texts(batch.column("text"))
            start = 0
            for doc_id, stop in zip(batch.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                if maker.index and maker.ids + stop - start + 1 > FILE_IDS:
                    yield pa.RecordBatch.from_pydict({"value": pa.array([maker.done()], pa.binary())})
                    maker = FileMaker()
                maker.add(doc_id, np.concatenate([ids[start:stop], end]))
                start = stop
        if maker.index:
            yield pa.RecordBatch.from_pydict({"value": pa.array([maker.done()], pa.binary())})

    files = ordered.mapInArrow(run, "value binary")
    files.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).option("compression", "none").text(path)


def _files(docs: DataFrame) -> int:
    """Range partitions: at least the session's shuffle partitions, more where the row count asks for it."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // 50_000))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, doc_id, n_tokens, ids_crc32) of every document in the files under path; file sorts as the files do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                reader = FileReader(data.as_py())
                index, n = reader.index, len(reader.index)
                crc = [zlib.crc32(reader.document(i)) for i in range(n)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([_place(name)] * n), pa.array(np.arange(n)),
                    pa.array(index["doc_id"], pa.int64(), mask=index["known"] == 0), pa.array(index["n"].astype(np.int64)), pa.array(crc, pa.int64()),
                ], names=["file", "place", "doc_id", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, place bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint")


def lookup(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids array<bigint>) of the documents whose doc_id is in wanted: only files that hold some are opened again, and only frames of theirs decompressed."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                index = FileReader(data.as_py()).index
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(index)), pa.array(np.arange(len(index))), pa.array(index["doc_id"], pa.int64(), mask=index["known"] == 0)], names=["path", "place", "doc_id"])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, places in zip(batch.column("content"), batch.column("places").to_pylist(), strict=True):
                reader = FileReader(data.as_py())
                for i in sorted(places):
                    ids = np.frombuffer(reader.document(i), "<u4").astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([int(reader.index[i]["doc_id"])], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    source = spark.read.format("binaryFile").option("pathGlobFilter", "part-*")
    index = source.load(path).select("path", "content").mapInArrow(listed, "path string, place bigint, doc_id bigint")
    places = written(index.join(wanted.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi").groupBy("path").agg(F.collect_list("place").alias("places")), "tokens-places")
    files = [r["path"] for r in places.select("path").limit(LISTED + 1).collect()]
    if not files:
        return spark.createDataFrame([], "doc_id long, ids array<bigint>")
    contents = source.load(files) if len(files) <= LISTED else source.load(path)
    return contents.select("path", "content").join(places, "path").select("content", "places").mapInArrow(opened, "doc_id bigint, ids array<bigint>")


def _place(name: str) -> str:
    """A sortable name: task number, then number of the file in the task."""
    m = re.search(r"part-(\d+)-.*?(?:-c(\d+))?\.txt$", name)
    return f"{int(m[1]):010d}-{int(m[2] or 0):010d}"


def positions(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write the files, read them back: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write(docs, vocabulary, path, end_id)
    rows = written(read(spark, path), "tokens-read")
    sums = rows.groupBy("file").agg(F.sum("n_tokens").alias("s"))
    before = sums.select("file", F.coalesce(F.sum("s").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("inside", inside).join(before, "file")
    return placed.select("doc_id", (F.col("before") + F.col("inside")).cast("long").alias("start"), "n_tokens", "ids_crc32")
