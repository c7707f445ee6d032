"""Token counts by greedy longest match, without building the tokens.

The vocabulary's trie gets failure links: from a node, when no child fits the
next byte, the link leads to where the matching goes on after some tokens have
been given out, and the number of these is stored with the link. So a word is
read once, byte by byte, and every byte is looked at in constant time on
average.
"""

from __future__ import annotations

import json
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salestally.llm.bpe import byte_letters, default_tokenizer
from salestally.llm.common import chunks, documents, fresh, map_batches, put, query

# words whose count a task keeps; the store starts anew beyond it
KEPT_WORDS = 300_000
CHUNK = 1_000_000


class Automaton:
    """Counts the tokens that greedy longest match takes from left to right.

    ``mark`` is put before every word, as vocabularies do that tell a word's first token from
    those that follow. A word that cannot be covered counts as one unknown token.
    """

    def __init__(self, tokens, mark: bytes = b""):
        self.mark = mark
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        ends = [False]
        for token in sorted(set(tokens) - {b""}):
            node = 0
            for byte in token:
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = len(ends)
                    ends.append(False)
                node = self.child[key]
            ends[node] = True
        self.link = [-1] * len(ends)  # -1: no way on
        self.given = [0] * len(ends)  # tokens given out on the way over the link
        children: list[list[tuple[int, int]]] = [[] for _ in ends]
        for key, node in self.child.items():
            children[key >> 8].append((key & 255, node))
        level = [0]
        while level:
            after = []
            for node in level:
                for byte, own in children[node]:
                    after.append(own)
                    if ends[own]:
                        self.link[own], self.given[own] = 0, 1
                        continue
                    at, given = self.link[node], self.given[node]
                    while at >= 0 and (at << 8 | byte) not in self.child:
                        given += self.given[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[own], self.given[own] = self.child[at << 8 | byte], given
            level = after
        self._known: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        child, link, given = self.child, self.link, self.given
        node = total = 0
        for byte in self.mark + word:
            while (node << 8 | byte) not in child:
                total += given[node]
                node = link[node]
                if node < 0:
                    return 1
            node = child[node << 8 | byte]
        while node > 0:
            total += given[node]
            node = link[node]
        return total if node == 0 else 1

    def counts(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Words and tokens of each text; words lie between ASCII white space."""
        words = [text.encode().split() for text in texts]
        new = set().union(*words).difference(self._known)
        if len(self._known) + len(new) > KEPT_WORDS:
            self._known.clear()
            new = set().union(*words)
        self._known.update((w, self.count(w)) for w in new)
        return list(map(len, words)), [sum(map(self._known.__getitem__, w)) for w in words]


@cache
def byte_automaton(path: str) -> Automaton:
    """For a byte-level vocabulary, whose tokens at the start of a word begin with a space."""
    with open(path, encoding="utf-8") as file:
        pieces = json.load(file)["model"]["vocab"]
    letters = byte_letters()
    return Automaton((bytes(letters[c] for c in piece) for piece in pieces), mark=b" ")


def token_counts(df: DataFrame, tokenizer: str, text: str = "text", words: str = "n_words",
                 tokens: str = "n_tokens") -> DataFrame:
    """``df`` with the numbers of words and of tokens of each text.

    Null and empty texts have none. Repeated rows stay, an empty table gives an empty table,
    other columns pass (columns named as the new ones are replaced).
    """
    name, = fresh(df, "text_in")
    rows = df.withColumn(name, df[text].cast("string"))
    rows = put(put(rows, words, F.lit(None).cast("long")), tokens, F.lit(None).cast("long"))
    schema = rows.drop(name).schema

    def run(batches):
        automaton = byte_automaton(tokenizer)
        for batch in batches:
            for start, texts in chunks(batch.column(name), CHUNK):
                made = dict(zip((words, tokens), automaton.counts(texts)))
                piece = batch.slice(start, len(texts))
                columns = [pa.array(made[f], pa.int64()) if f in made else piece.column(f) for f in schema.names]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return map_batches(rows, run, schema)


@query("op3_token_counts")
def op3_token_counts(spark, sf_dir):
    """Words and word-piece tokens of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return token_counts(docs, default_tokenizer()).select("doc_id", "n_words", "n_tokens")
