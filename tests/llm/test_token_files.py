"""Token files against the tokenizers library, and their format against a plain reader."""

import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from salestally.llm import QUERIES, token_files
from salestally.llm.token_files import Encoder, Reader
from rows import odd_rows

PATH = token_files.default_tokenizer()
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()
ENCODER = Encoder(PATH, 2)


def plain(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]


def unpack(packed):
    return np.frombuffer(packed, "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("abTS  \n'sre.,;!_`<|endoftext|>éÉİıßẞǺ̈ŉ中\U0001f600\x1c\x85\xa0 09-=\t\r"), max_size=50)
                | st.text(max_size=30), min_size=1, max_size=4))
def test_any_text(texts):
    ids, counts = ENCODER.encode(texts)
    assert [list(x) for x in np.split(ids, np.cumsum(counts)[:-1])] == [plain(t) for t in texts]


def test_hard_texts():
    texts = ["it's. IT'S! 'tis, we'll; '' ``'s`` a_!! b_. c`. <|ENDOFTEXT|> <|endoftext|>", "x" * 5000 + "," * 300, "é ́x ≠ a≠.",
             "Σς ΣΑΣ. İ. ŉ, ǅ; Å", "a\x1cb \x85 c d　e.", "", " ", "\n\n"]
    ids, counts = ENCODER.encode(texts)
    assert [list(x) for x in np.split(ids, np.cumsum(counts)[:-1])] == [plain(t) for t in texts]


def test_forgetting(monkeypatch):
    monkeypatch.setattr(token_files, "KEPT", 10)
    for texts in (["one two three four five"], ["six one", "two"], ["one"]):
        ids, counts = ENCODER.encode(texts)
        assert [list(x) for x in np.split(ids, np.cumsum(counts)[:-1])] == [plain(t) for t in texts]


def plain_file(path):
    """Keys and ids by the format's own words, frame after frame."""
    data = open(path, "rb").read()
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    assert magic == 0x8F92EAB1 and flags == 0x80
    table = data[-9 - 12 * n:-9]
    assert struct.unpack("<II", data[-17 - 12 * n:-9 - 12 * n]) == (0x184D2A5E, 12 * n + 9)
    frames, at = [], 0
    for i in range(n):
        packed, size, check = struct.unpack_from("<III", table, 12 * i)
        frames.append(zstandard.ZstdDecompressor().decompress(data[at:at + packed]))
        assert len(frames[-1]) == size and xxhash.xxh64(frames[-1]).intdigest() & 0xFFFFFFFF == check
        at += packed
    assert at == len(data) - 17 - 12 * n
    *ids, index = frames
    count, = struct.unpack_from("<q", index)
    keys = struct.unpack_from(f"<{count}q", index, 8)
    known, counts = index[8 + 8 * count:8 + 9 * count], struct.unpack_from(f"<{count}q", index, 8 + 9 * count)
    flat, out, at = unpack(b"".join(ids)), [], 0
    for key, is_known, size in zip(keys, known, counts):
        out.append((key if is_known else None, flat[at:at + size]))
        at += size
    assert at == len(flat)
    return out


@pytest.mark.parametrize("frame, file", [(1 << 20, 256 << 20), (400, 4000)])
def test_files(spark, odd, clashing, tmp_path, monkeypatch, frame, file):
    monkeypatch.setattr(token_files, "FRAME", frame)  # the small ones count where tasks share this process's memory
    monkeypatch.setattr(token_files, "FILE", file)
    for name, df in (("odd", odd), ("clashing", clashing)):
        folder = str(tmp_path / name)
        files = token_files.write(df, folder, PATH, 2).collect()
        held = [doc for f in files for doc in plain_file(f.path)]
        want = Counter((r.doc_id, tuple(plain(r.text))) for r in df.select("doc_id", "text").collect())
        assert Counter((k, tuple(ids)) for k, ids in held) == want
        keys = [k for k, _ in held]
        assert keys == sorted(keys, key=lambda k: (k is not None, k))
        starts = np.cumsum([0] + [len(ids) for _, ids in held])
        found = token_files.read(spark, folder).collect()
        assert sorted((r.start, r.n_tokens, unpack(r.ids)) for r in found) == [
            (int(s), len(ids), ids) for s, (_, ids) in zip(starts, held)]
        some = token_files.read_some(spark, folder, spark.createDataFrame([(7,), (9,), (9,), (None,), (4000,)], "doc_id long"))
        assert Counter((r.doc_id, tuple(unpack(r.ids))) for r in some.collect()) == Counter({k: n for k, n in want.items() if k[0] in (7, 9)})


def test_small_frames(tmp_path, monkeypatch):
    """Documents over several frames; only the frames that are asked for are unpacked."""
    monkeypatch.setattr(token_files, "FRAME", 40)
    docs = [(5, 3), (6, 0), (7, 25), (None, 9), (8, 10), (9, 1)]
    writer = token_files.Writer(str(tmp_path / "a.ids.zst"))
    for key, size in docs:
        writer.add(key, np.arange(size, dtype=np.uint32) + 100)
    writer.close()
    assert plain_file(writer.path) == [(k, list(range(100, 100 + n))) for k, n in docs]
    reader, seen = Reader(writer.path), []
    take = reader.frame
    monkeypatch.setattr(reader, "frame", lambda i: seen.append(i) or take(i))
    assert [len(ids) // 4 for _, ids in reader.read([0, 2, 5])] == [3, 25, 1]
    assert len(seen) == len(set(seen)) < len(reader.packed) - 1


def test_damage_is_noticed(tmp_path):
    writer = token_files.Writer(str(tmp_path / "a.ids.zst"))
    writer.add(1, np.arange(50, dtype=np.uint32))
    writer.close()
    data = bytearray(open(writer.path, "rb").read())
    data[-9 - 12 + 8 - 12] ^= 1  # the first frame's checksum
    open(tmp_path / "b.ids.zst", "wb").write(data)
    with pytest.raises(ValueError, match="frame 0 is broken"):
        list(Reader(str(tmp_path / "b.ids.zst")).read([0]))
    open(tmp_path / "c.ids.zst", "wb").write(data[:-5])
    with pytest.raises(ValueError, match="seek table"):
        Reader(str(tmp_path / "c.ids.zst"))


def test_lost_tasks_leave_nothing(spark, odd, tmp_path):
    """Files that the manifest does not name are not read."""
    folder = str(tmp_path / "x")
    token_files.write(odd, folder, PATH, 2)
    writer = token_files.Writer(folder + "/ids/000000-0000-lost.ids.zst")
    writer.add(99, np.arange(5, dtype=np.uint32))
    writer.close()
    assert token_files.read(spark, folder).count() == len(odd_rows())


def test_no_documents(spark, none, tmp_path):
    assert token_files.written(none, str(tmp_path / "none")).collect() == []


def test_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want, at = [], 0
    for r in sorted(docs, key=lambda r: r.doc_id):
        ids = plain(r.text)
        want.append((r.doc_id, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert sorted(map(tuple, QUERIES["op12_token_files"](spark, folder).collect())) == want
