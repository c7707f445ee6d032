"""Byte-pair encoding and decoding.

The encoding of a prefix of a word ends in one certain token, and what stands
before that token is the encoding of a shorter prefix. So the last token of
every prefix holds the whole encoding. The distinct words of a batch form a
trie; going through it depth first, the last token of a node is found from
those of its ancestors: among the tokens that end there, exactly one can stand
behind the last token of the prefix before it. What words share is computed
once.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salestally.llm.common import chunks, documents, fresh, map_batches, put, query

# words whose encoding a task keeps, and characters in them; the store starts anew beyond either
KEPT_WORDS, KEPT_CHARACTERS = 150_000, 4_000_000
# pairs of tokens whose verdict it keeps
KEPT_PAIRS = 200_000
# characters of text that are encoded together
CHUNK = 1_000_000

# splits text into words before the merges (fixed: the vocabulary was made with it)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in a vocabulary file, and the byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@cache
def doubtful() -> re.Pattern:
    """Characters that one Unicode version calls letters or numbers and another does not."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    now = {"L": set(regex.findall(r"\p{L}", every)), "N": set(regex.findall(r"\p{N}", every))}
    odd = [c for c in every
           if any((unicodedata.category(c)[0] == kind) != (c in have) for kind, have in now.items())]
    return re.compile("[" + "".join(map(re.escape, odd)) + "]") if odd else re.compile(r"(?!)")


# up to here all Unicode versions agree on letters and numbers
AGREED = 0x558


@cache
def plain_splitter() -> re.Pattern:
    """The pattern for texts of characters below ``AGREED``, where a few ranges name the classes."""
    def ranges(kind: str) -> str:
        return "".join(chr(c) for c in range(AGREED) if unicodedata.category(chr(c))[0] == kind)

    letter, number, space = re.escape(ranges("L")), re.escape(ranges("N")), r"\t-\r \x85\xa0"
    return re.compile(rf" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^{space}{letter}{number}]+"
                      rf"|[{space}]+(?![^{space}])|[{space}]+")


class Vocabulary:
    """A byte-level vocabulary with its merges, from a ``tokenizers`` file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.text = file.read()
        parts = json.loads(self.text)
        letters = byte_letters()
        to_bytes = lambda piece: bytes(letters[c] for c in piece)
        ids = {to_bytes(piece): i for piece, i in parts["model"]["vocab"].items()}
        self.special = {a["content"]: a["id"] for a in parts["added_tokens"]}
        self.bytes_of = {i: piece for piece, i in ids.items()}
        self.bytes_of |= {i: piece.encode() for piece, i in self.special.items()}
        self.merges: dict[tuple[int, int], int] = {}  # pair -> rank of the merge
        self.halves: dict[int, tuple[int, int, int]] = {}  # token -> rank, left, right
        for rank, merge in enumerate(parts["model"]["merges"]):
            left, right = map(to_bytes, merge.split(" ") if isinstance(merge, str) else merge)
            pair, whole = (ids[left], ids[right]), ids[left + right]
            if self.merges.setdefault(pair, rank) == rank and whole not in self.halves:
                self.halves[whole] = (rank, *pair)
        self._fits: dict[int, bool] = {}  # by the two tokens in one number
        # tokens that the merges make of their own bytes
        self.ids = {piece: i for piece, i in ids.items()
                    if len(piece) == 1 or i in self.halves
                    and self._stay(*self.halves[i][1:], self.halves[i][0])}
        # every ending of a token, with the token that it is, or -1
        self.ends = {piece[k:]: -1 for piece in self.ids for k in range(len(piece))} | self.ids
        self.sizes = {i: len(piece) for i, piece in self.bytes_of.items()}
        self._split = regex.compile(PATTERN)
        self._beyond = re.compile(f"[{chr(AGREED)}-\U0010ffff]")
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._held = 0
        self._words: dict[str, bytes] = {s: array("I", [i]).tobytes() for s, i in self.special.items()}

    def _stay(self, left: int, right: int, below: int) -> bool:
        """Do the two tokens stay apart when merges of rank under ``below`` run over their bytes?

        Undo the merges at the seam, latest first. Had a merge across the seam
        been due earlier than the one undone, it would have come first. Of two
        merges of one rank the left one comes first.
        """
        while True:
            across = self.merges.get((left, right))
            if across is not None and across < below:
                return False
            l, r = self.halves.get(left), self.halves.get(right)
            if l is None and r is None:
                return True
            if r is None or l is not None and l[0] > r[0]:
                below, left = l[0], l[2]
            else:
                below, right = r[0] + 1, r[1]

    def encode_words(self, words) -> dict[bytes, bytes]:
        """Packed ids of distinct words.

        In sorted order words are the leaves of their trie, depth first; ``path``
        holds the last tokens of the nodes from the root to the present one.
        """
        out, path, before = {}, [], b""
        ends, known, sizes = self.ends, self._fits, self.sizes
        for word in sorted(words):
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del path[shared:]
            for end in range(shared + 1, len(word) + 1):
                start = end - 1
                while True:
                    token = ends[word[start:end]]
                    if token >= 0:
                        if start == 0:
                            break
                        pair = path[start - 1] << 32 | token
                        if pair not in known:
                            known[pair] = self._stay(path[start - 1], token, len(self.merges))
                        if known[pair]:
                            break
                    start -= 1
                path.append(token)
            ids, at = [], len(word)
            while at:
                ids.append(path[at - 1])
                at -= sizes[ids[-1]]
            out[word] = array("I", reversed(ids)).tobytes()
            before = word
        if len(known) > KEPT_PAIRS:
            known.clear()
        return out

    def words(self, text: str) -> list[str]:
        """The text in words, in order; a special token is a word of its own."""
        parts = self._special.split(text) if self._special else [text]
        out = []
        for part in parts:
            if part in self.special:
                out.append(part)
            elif part.isascii() or not self._beyond.search(part):
                out += plain_splitter().findall(part)
            elif doubtful().search(part):
                out += [part[a:b] for _, (a, b) in self._library.pre_tokenize_str(part)]
            else:
                out += self._split.findall(part)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        split = [self.words(text) for text in texts]
        new = set().union(*split).difference(self._words)
        self._held += sum(map(len, new))
        if len(self._words) + len(new) > KEPT_WORDS or self._held > KEPT_CHARACTERS:
            special = {s: self._words[s] for s in self.special}
            new = set().union(*split).difference(special)
            self._words, self._held = special, sum(map(len, new))
        by_bytes = {word.encode(): word for word in new}
        for word, ids in self.encode_words(by_bytes).items():
            self._words[by_bytes[word]] = ids
        return [b"".join(map(self._words.__getitem__, words)) for words in split]

    def decode(self, packed: bytes) -> str:
        """Ids without an entry decode to nothing; broken characters become U+FFFD."""
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self._pieces.__getitem__, ids)).decode("utf-8", "replace")

    @cached_property
    def _library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.text).pre_tokenizer

    @cached_property
    def _pieces(self) -> "Pieces":
        return Pieces(self.bytes_of)


class Pieces(dict):
    def __missing__(self, _):
        return b""


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", unpack: bool = False) -> DataFrame:
    """``df`` with a column ``ids``: the text's token ids, packed as little-endian unsigned
    32-bit integers as training shards hold them, or as an array with ``unpack``.

    The file ``tokenizer`` must lie at the same path on every machine. A null or empty text has
    no ids. Rows are treated one by one: repeated rows stay, an empty table gives an empty
    table, other columns pass (a column named as ``ids`` is replaced).
    """
    name, = fresh(df, "text_in")
    rows = put(df.withColumn(name, df[text].cast("string")), ids, F.lit(None).cast("binary"))
    schema = rows.drop(name).schema

    def run(batches):
        vocab = vocabulary(tokenizer)
        for batch in batches:
            for start, texts in chunks(batch.column(name), CHUNK):
                piece = batch.slice(start, len(texts))
                columns = [pa.array(vocab.encode(texts), pa.binary()) if f == ids else piece.column(f)
                           for f in schema.names]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    out = map_batches(rows, run, schema)
    if unpack:
        out = out.withColumn(ids, _unpacked(out[ids]))
    return out


def _unpacked(packed):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def numbers(column):
        return column.map(lambda b: np.frombuffer(b or b"", "<u4").astype("int64"))

    return numbers(packed)


def encode_and_decode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the columns of ``encode`` and ``decode``, made by one worker from one vocabulary.

    Texts go through in chunks of bounded size, so a worker holds one chunk's ids and texts
    besides the vocabulary. Null, empty and very long texts, repeated rows, empty tables and
    clashing columns are treated as by ``encode``.
    """
    name, = fresh(df, "text_in")
    rows = put(put(df.withColumn(name, df[text].cast("string")), ids, F.lit(None).cast("binary")), decoded, F.lit(None).cast("string"))
    schema = rows.drop(name).schema

    def run(batches):
        vocab = vocabulary(tokenizer)
        for batch in batches:
            for start, texts in chunks(batch.column(name), CHUNK):
                piece = batch.slice(start, len(texts))
                packed = vocab.encode(texts)
                made = {ids: pa.array(packed, pa.binary()), decoded: pa.array(map(vocab.decode, packed), pa.string())}
                yield pa.RecordBatch.from_arrays([made[f] if f in made else piece.column(f) for f in schema.names], schema.names)

    return map_batches(rows, run, schema)


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with a column ``text``: what the packed ids say, special tokens included.

    Null or no ids give an empty text; ids that the vocabulary does not have are passed over.
    """
    name, = fresh(df, "ids_in")
    rows = put(df.withColumn(name, df[ids]), text, F.lit(None).cast("string"))
    schema = rows.drop(name).schema

    def run(batches):
        vocab = vocabulary(tokenizer)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                piece = batch.slice(start, 1000)
                texts = [vocab.decode(b.as_py() or b"") for b in piece.column(name)]
                columns = [pa.array(texts, pa.string()) if f == text else piece.column(f) for f in schema.names]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return map_batches(rows, run, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_bpe")
def op1_bpe(spark, sf_dir):
    """Every document's ids and decoded text, as digests."""
    return digests(documents(spark, sf_dir).select("doc_id", "text"))


def digests(docs: DataFrame) -> DataFrame:
    path = default_tokenizer()
    return encode_and_decode(docs, path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
