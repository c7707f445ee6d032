"""Token ids in binary files whose documents can be read one by one.

A file is a row of independent zstandard frames. The first ones hold ids as little-endian
unsigned 32-bit integers: whole documents, or pieces of one that is longer than a frame. Then
comes a frame with the index: how many documents, their keys (signed 64 bit), whether each key
is known (one byte), and their numbers of ids (64 bit). Last comes a seek table in a skippable
frame, as zstandard's seekable format lays it down: the compressed and the plain size and the
checksum of every frame, the number of frames, and a magic number. A reader takes the table from
the end of the file and after it only the frames it needs, each held against its checksum.

Documents lie in ascending order of their keys, in a file and over the files. The files of a
folder that count are those its manifest names: a task that is run again writes a file of
another name, and what the lost one left is never read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salestally.llm.common import chunks, documents, map_batches, query
from salestally.session import scratch

# plain bytes of a frame, and of the ids of a file
FRAME, FILE = 1 << 20, 256 << 20
# documents of a file
FILE_DOCUMENTS = 1_000_000
# characters of text that are encoded together, and of the pieces that a worker remembers
CHUNK, KEPT = 4_000_000, 8_000_000
# stands between pieces that are encoded together
MARK = "`"
# characters that the vocabulary's normal form may change otherwise than by lower case
COMPOSED = re.compile("[^\x00-\u012f\u0131-\u024f]")
# a letter, symbols (none that special tokens end with), a blank
TAIL = r"([a-z])([!-&(-/:-@\[-^{}~]+)([ \n]|\z)"
# bytes of ids that a reader hands on together
HANDED = 8 << 20

# the seekable format (fixed values)
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80  # bit of the descriptor: entries have checksums
ENTRY, FOOTER, HEADER = struct.Struct("<III"), struct.Struct("<IBI"), struct.Struct("<II")


# --- text to ids ---------------------------------------------------------------------


class Encoder:
    """The tokenizers library, asked once for every distinct piece of text.

    The vocabulary's tokens never cross white space, nor do they go on from a letter into a
    symbol, so a text's ids are those of its pieces in order. Pieces are remembered up to
    ``KEPT`` characters and then forgotten.
    """

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.end = end
        self.mark, = self.library.encode(MARK, add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.held = {"": 0}, 0
        self.starts, self.sizes, self.flat = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(0, np.uint32)]
        self.used = 0

    def _learn(self, new: list[str]) -> None:
        """Pieces are given to the library as one text, parted by a mark that has a token of its own."""
        plain = [p for p in new if MARK not in p]
        odd = [p for p in new if MARK in p]
        texts = [f" {MARK} ".join(plain[i:i + 1000]) + f" {MARK}" for i in range(0, len(plain), 1000)]
        found = [np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts]
        for ids in found:
            ends = np.flatnonzero(ids == self.mark)
            sizes = np.diff(np.r_[-1, ends]) - 1
            self._add(sizes, ids[ids != self.mark])
        for p in odd:
            ids = np.array(self.library.encode(p, add_special_tokens=False).ids, np.uint32)
            self._add(np.array([len(ids)], np.int64), ids)
        at = len(self.numbers)
        self.numbers.update(zip(plain + odd, range(at, at + len(new))))
        self.held += sum(map(len, new))

    def _add(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.starts.append(self.used + np.cumsum(sizes) - sizes)
        self.sizes.append(sizes)
        self.flat.append(ids)
        self.used += len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one behind the other, each with the end id, and how many each has."""
        split = pieces(texts)
        distinct = split.values.dictionary_encode()
        held = distinct.dictionary.to_pylist()
        if self.held > KEPT:
            self._forget()
        new = [p for p in held if p not in self.numbers]
        if new:
            self._learn(new)
        starts, sizes, flat = map(np.concatenate, (self.starts, self.sizes, self.flat))
        self.starts, self.sizes, self.flat = [starts], [sizes], [flat]
        number = np.fromiter(map(self.numbers.__getitem__, held), np.int64, len(held))[distinct.indices.to_numpy()]
        long = sizes[number]
        text_of = np.repeat(np.arange(len(split)), split.value_lengths().to_numpy())
        counts = np.bincount(text_of, long, len(split)).astype(np.int64) + 1
        out = np.full(int(counts.sum()), self.end, np.uint32)
        # ids of one piece stand together: the place in ``flat`` runs on from the piece's start
        total = int(long.sum())
        into = np.cumsum(long) - long
        place = np.arange(total)
        ids = flat[np.repeat(starts[number] - into, long) + place]
        out[place + np.repeat(text_of, long)] = ids  # one end id for every text before
        return out, counts


def pieces(texts: list[str]) -> pa.ListArray:
    """Texts split at blanks, and before symbols that end a word."""
    # lower case as the vocabulary's own rules do; special tokens are told by their case
    lower = [t if "<|" in t or COMPOSED.search(t) else t.lower() for t in texts]
    parted = pc.replace_substring_regex(pa.array(lower, pa.large_string()), TAIL, r"\1 \2\3")
    return pc.split_pattern(pc.replace_substring(parted, "\n", " "), " ")


@cache
def encoder(path: str, end: int) -> Encoder:
    return Encoder(path, end)


# --- files ------------------------------------------------------------------------------


def open_file(path: str, mode: str):
    """A binary file of the shared folder, by Arrow's file systems."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    system, inner = fs.FileSystem.from_uri(path)
    if mode == "r":
        return system.open_input_file(inner)
    return system.open_output_stream(inner, compression=None)


def checksum(plain: bytes) -> int:
    import xxhash

    return xxhash.xxh64(plain).intdigest() & 0xFFFFFFFF


class Writer:
    """One file. Holds a frame's ids and the index, never the whole file."""

    def __init__(self, path: str):
        import zstandard

        self.path, self.out = path, open_file(path, "w")
        self.pack = zstandard.ZstdCompressor(level=3).compress
        self.entries: list[tuple[int, int, int]] = []
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = self.n_bytes = 0
        self.keys: list[int | None] = []
        self.counts: list[int] = []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.n_bytes += len(data)

    def _frame(self, plain: bytes) -> None:
        packed = self.pack(plain)
        self._write(packed)
        self.entries.append((len(packed), len(plain), checksum(plain)))

    def _flush(self) -> None:
        if self.n_held:
            self._frame(np.concatenate(self.held).astype("<u4").tobytes())
            self.held, self.n_held = [], 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.counts.append(len(ids))
        self.n_ids += len(ids)
        if (self.n_held + len(ids)) * 4 > FRAME:
            self._flush()
        for start in range(0, len(ids), FRAME // 4):
            piece = ids[start:start + FRAME // 4]
            self.held.append(piece)
            self.n_held += len(piece)
            if self.n_held * 4 >= FRAME:
                self._flush()

    def full(self) -> bool:
        return self.n_ids * 4 >= FILE or len(self.keys) >= FILE_DOCUMENTS

    def close(self) -> tuple[str, int, int, int]:
        """Path, number of documents, of ids, and of bytes."""
        self._flush()
        known = np.array([k is not None for k in self.keys], np.uint8)
        keys = np.array([k or 0 for k in self.keys], "<i8")
        self._frame(struct.pack("<q", len(keys)) + keys.tobytes() + known.tobytes()
                    + np.array(self.counts, "<i8").tobytes())
        table = b"".join(ENTRY.pack(*e) for e in self.entries)
        tail = table + FOOTER.pack(len(self.entries), CHECKSUMS, SEEKABLE)
        self._write(HEADER.pack(SKIPPABLE, len(tail)) + tail)
        self.out.close()
        return self.path, len(keys), self.n_ids, self.n_bytes


class Reader:
    """One file: seek table and index at once, frames when they are asked for."""

    def __init__(self, path: str):
        import zstandard

        self.path, self.file = path, open_file(path, "r")
        self.unpack = zstandard.ZstdDecompressor().decompress
        size = self.file.size()
        if size < FOOTER.size + HEADER.size:
            raise ValueError(f"{path} has no seek table")
        n, flags, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError(f"{path} has no seek table with checksums")
        tail = n * ENTRY.size + FOOTER.size
        head = HEADER.unpack(self._at(size - tail - HEADER.size, HEADER.size))
        if head != (SKIPPABLE, tail):
            raise ValueError(f"{path}: the seek table is broken")
        entries = np.frombuffer(self._at(size - tail, n * ENTRY.size), "<u4").reshape(n, 3).astype(np.int64)
        self.packed, self.plain, self.sums = entries.T
        self.begins = np.cumsum(self.packed) - self.packed
        index = self.frame(n - 1)
        count, = struct.unpack_from("<q", index)
        self.keys = np.frombuffer(index, "<i8", count, 8)
        self.known = np.frombuffer(index, np.uint8, count, 8 + 8 * count).astype(bool)
        self.counts = np.frombuffer(index, "<i8", count, 8 + 9 * count)
        self.starts = np.cumsum(self.counts) - self.counts
        # where the ids of each frame begin; the last entry is their end
        self.firsts = np.r_[0, np.cumsum(self.plain[:n - 1])] // 4

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def frame(self, i: int) -> bytes:
        plain = self.unpack(self._at(int(self.begins[i]), int(self.packed[i])), int(self.plain[i]))
        if len(plain) != self.plain[i] or checksum(plain) != self.sums[i]:
            raise ValueError(f"{self.path}: frame {i} is broken")
        return plain

    def read(self, places) -> Iterator[tuple[int, bytes]]:
        """Documents by their ascending places in the file, with their ids; a frame is unpacked once."""
        now, held = -1, b""
        for place in places:
            start, stop = int(self.starts[place]), int(self.starts[place] + self.counts[place])
            parts = []
            i = int(np.searchsorted(self.firsts, start, "right")) - 1
            while start < stop:
                if now != i:
                    now, held = i, self.frame(i)
                until = min(stop, int(self.firsts[i + 1]))
                parts.append(held[(start - int(self.firsts[i])) * 4:(until - int(self.firsts[i])) * 4])
                start, i = until, i + 1
            yield place, parts[0] if len(parts) == 1 else b"".join(parts)

    def close(self) -> None:
        self.file.close()


# --- the operator --------------------------------------------------------------------------


def write(df: DataFrame, folder: str, tokenizer: str, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of all texts, each followed by the id ``end``, and give back the manifest.

    The manifest has a row per file: ``place`` (its rank), ``path``, ``n_docs``, ``n_ids``,
    ``n_bytes`` and ``start``, the number of ids in all files before. Documents are ranged by key
    (null first); those of one key by a hash of their texts, then by the partition they were read
    from, so that a key with many rows is spread over tasks; equal rows all stay. A null or
    empty text has the end id alone. A long text takes several frames. An empty table gives a
    manifest without rows. Further columns are not written; none can clash.
    """
    root = os.path.join(folder, "ids")
    rows = df.select(df[key].cast("long").alias("key"), F.coalesce(df[text].cast("string"), F.lit("")).alias("body"))
    order = ["key", "tie"]
    rows = rows.withColumn("tie", F.xxhash64("body")).withColumn("from", F.spark_partition_id())
    dealt = rows.repartitionByRange(*order, "from").sortWithinPartitions(*order)

    def run(batches):
        number, writer = 0, None
        task = TaskContext.get().partitionId()
        code = encoder(tokenizer, end)

        def closed():
            path, n_docs, n_ids, n_bytes = writer.close()
            return pa.RecordBatch.from_pydict({
                "task": pa.array([task], pa.int32()), "number": pa.array([number], pa.int32()), "path": [path],
                "n_docs": [n_docs], "n_ids": [n_ids], "n_bytes": [n_bytes]})

        for batch in batches:
            keys = batch.column("key").to_pylist()
            for start, texts in chunks(batch.column("body"), CHUNK):
                ids, counts = code.encode(texts)
                at = 0
                for i, count in enumerate(counts.tolist()):
                    if writer is None:
                        writer = Writer(os.path.join(root, f"{task:06d}-{number:04d}-{uuid.uuid4().hex}.ids.zst"))
                    writer.add(keys[start + i], ids[at:at + count].copy())
                    at += count
                    if writer.full():
                        yield closed()
                        number, writer = number + 1, None
        if writer is not None:
            yield closed()

    _make_folder(root)
    schema = "task int, number int, path string, n_docs long, n_ids long, n_bytes long"
    files = map_batches(dealt.select("key", "body"), run, schema)
    files.write.parquet(os.path.join(folder, "files"))
    return manifest(df.sparkSession, folder)


def _make_folder(path: str) -> None:
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    system, inner = fs.FileSystem.from_uri(path)
    system.create_dir(inner, recursive=True)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder, in order. One row per file of up to 256 MB, so the sort over all is small."""
    files = spark.read.schema("task int, number int, path string, n_docs long, n_ids long, n_bytes long").parquet(
        os.path.join(folder, "files"))
    before = Window.orderBy("task", "number")
    return files.select(
        (F.row_number().over(before) - 1).alias("place"), "path", "n_docs", "n_ids", "n_bytes",
        F.coalesce(F.sum("n_ids").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))


READ_SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


def _rows(found: Iterator[tuple[int | None, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Batches of bounded bytes."""
    keys, starts, ids, size = [], [], [], 0

    def batch():
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array([len(i) // 4 for i in ids], pa.int64()),
             pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    for key, start, packed in found:
        keys.append(key)
        starts.append(start)
        ids.append(packed)
        size += len(packed) + 32
        if size >= HANDED:
            yield batch()
            keys, starts, ids, size = [], [], [], 0
    if keys:
        yield batch()


def read(spark: SparkSession, folder: str, tasks: int = 10_000) -> DataFrame:
    """All documents of a folder: ``doc_id``, ``start`` (ids before it), ``n_tokens``, packed ``ids``.

    A task reads whole files, one frame at a time; there are at most ``tasks`` of them.
    """
    files = manifest(spark, folder)
    n = files.count()

    def run(batches):
        def found():
            for batch in batches:
                for row in batch.to_pylist():
                    file = Reader(row["path"])
                    for place, ids in file.read(range(len(file.keys))):
                        key = int(file.keys[place]) if file.known[place] else None
                        yield key, row["start"] + int(file.starts[place]), ids
                    file.close()
        yield from _rows(found())

    # a given number of tasks, since the size of the manifest says nothing about that of the files
    return map_batches(files.repartition(max(1, min(n, tasks))), run, READ_SCHEMA)


def index(spark: SparkSession, folder: str, tasks: int = 10_000) -> DataFrame:
    """Where each document lies: ``doc_id``, ``path``, ``at`` (its place in the file), ``file_start``.

    Of every file the seek table and the index frame are read, and no ids.
    """
    files = manifest(spark, folder)
    n = files.count()

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                file = Reader(row["path"])
                for start in range(0, len(file.keys), 100_000):
                    part = slice(start, start + 100_000)
                    size = len(file.keys[part])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(file.keys[part], pa.int64(), mask=~file.known[part]), pa.array([row["path"]] * size),
                         pa.array(np.arange(start, start + size)), pa.array([row["start"]] * size, pa.int64())],
                        ["doc_id", "path", "at", "file_start"])
                file.close()

    return map_batches(files.repartition(max(1, min(n, tasks))), run,
                       "doc_id long, path string, at long, file_start long")


def read_some(spark: SparkSession, folder: str, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents whose keys ``wanted`` has, with the columns of ``read``.

    Only frames that hold a wanted document are read and unpacked. Null keys are not found.
    """
    keys = wanted.select(F.col(key).cast("long").alias("doc_id")).distinct()
    places = index(spark, folder).join(keys, "doc_id", "left_semi")
    n = spark.conf.get("spark.sql.shuffle.partitions")
    dealt = places.repartition(int(n), "path").sortWithinPartitions("path", "at")

    def run(batches):
        def found():
            file = None
            for batch in batches:
                rows = batch.to_pylist()
                while rows:
                    path = rows[0]["path"]
                    same = [r for r in rows if r["path"] == path]
                    rows = rows[len(same):]
                    if file is None or file.path != path:
                        if file is not None:
                            file.close()
                        file = Reader(path)
                    first = same[0]["file_start"]
                    for place, ids in file.read([r["at"] for r in same]):
                        yield int(file.keys[place]), first + int(file.starts[place]), ids
            if file is not None:
                file.close()
        yield from _rows(found())

    return map_batches(dealt, run, READ_SCHEMA)


END = 2


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def written(docs: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: key, place of its first id, number of ids, and their checksum."""
    write(docs, folder, default_tokenizer(), END)
    return read(docs.sparkSession, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op12_token_files")
def op12_token_files(spark, sf_dir):
    """All documents written as token ids and read back."""
    return written(documents(spark, sf_dir), scratch(spark, "token-files"))
