"""Personal data by weak supervision.

Regular expressions, word lists and the words around a span each vote on
whether a candidate span is personal data. Expectation maximisation over the
counts of vote patterns estimates how reliable every labeler is; the resulting
probabilities train a classifier of spans. Spans of the base kinds that pass
their own test are always kept; the classifier adds others.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salestally.llm.common import documents, fresh, map_batches, put, query

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "key", "secret")

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# candidates beyond the base kinds
KEY = re.compile(r"[A-Z0-9]{16,}")
SECRET = re.compile(r"([A-Za-z_]{2,24})\x20?[=:]\x20?([\"']?)([A-Za-z0-9+/_.!@$%^&*-]{6,})\2")
LOCAL_PHONE = re.compile(r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")

# word lists of the gazetteer labelers
SECRET_NAMES = frozenset(["password", "passwd", "pwd", "pass", "token", "secret", "key", "apikey", "api_key", "auth", "bearer",
                          "credential", "credentials", "access_key", "secret_key", "passphrase", "pin"])
KEY_STARTS = ("AKIA", "ASIA", "AIZA", "GHP", "SK")
# words that stand before personal data
NEAR = frozenset(["call", "phone", "tel", "telephone", "mobile", "fax", "contact", "mail", "email", "address", "card", "account",
                  "key", "token", "password", "secret", "ip", "host", "login", "user"])
AROUND = 40  # characters looked at before a span


def emails(text: str):
    """Leftmost, non-overlapping: around each @ as far left as its characters allow."""
    at, floor = text.find("@"), 0
    while at >= 0:
        start = floor + len(text[floor:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        floor = found.end() if found else at + 1
        if found:
            yield start, found.end()
        at = text.find("@", floor)


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(values[0::2] + [2 * v - 9 * (v > 4) for v in values[1::2]]) % 10 == 0


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds that pass their tests, in code points, by kind and start."""
    out = [("email", a, b) for a, b in emails(text)]
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text)
                if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        number = digits(m.group())
        if 16 <= len(number) <= 19 and luhn(number):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]
    return out


def variety(text: str) -> float:
    """Share of different characters."""
    return len(set(text)) / max(len(text), 1)


def alone(text: str, *around: int) -> bool:
    """Are there no letters or digits at these places?"""
    return not any(0 <= i < len(text) and text[i].isalnum() for i in around)


@dataclass(frozen=True)
class Candidate:
    kind: str
    start: int
    end: int
    votes: tuple[int, ...]  # per labeler: 1 personal, 0 not, -1 no opinion
    features: tuple[int, ...]  # of the final classifier


LABELERS = ("shape", "name list", "context", "mixed characters", "plain word", "too regular")


def candidates(text: str) -> list[Candidate]:
    """Spans beyond the base kinds, with votes and features."""
    found: list[tuple[str, int, int, str, str]] = []
    found += [("key", m.start(), m.end(), m.group(), "") for m in KEY.finditer(text)
              if alone(text, m.start() - 1, m.end())]
    if "=" in text or ":" in text:
        found += [("secret", m.start(3), m.end(3), m.group(3), m.group(1)) for m in SECRET.finditer(text)]
    if "-" in text or "." in text or ")" in text:
        for m in LOCAL_PHONE.finditer(text):
            start = m.start() - (text[m.start() - 1:m.start()] == "(")
            if text[start - 1:start] not in ("+", *"0123456789"):
                found.append(("phone", start, m.end(), text[start:m.end()], ""))
    out = []
    for kind, start, end, span, name in found:
        n_digits, letters = len(digits(span)), sum(c.isalpha() for c in span)
        mixed = n_digits > 0 and letters > 0
        before = {w.lower() for w in re.findall(r"[A-Za-z_]+", text[max(0, start - AROUND):start])}
        listed = name.lower() in SECRET_NAMES if kind == "secret" else span.startswith(KEY_STARTS) if kind == "key" else None
        shape = {"key": mixed and len(span) % 4 == 0, "secret": mixed and len(span) >= 8,
                 "phone": 10 <= n_digits <= 11}[kind]
        near = bool(before & NEAR)
        votes = (
            int(shape),
            -1 if listed is None else int(listed),
            1 if near else -1,
            -1 if kind == "phone" else int(mixed),
            0 if letters == len(span) else -1,
            0 if variety(span) < 0.2 else -1,
        )
        features = (KINDS.index(kind), int(bool(listed)), int(near), int(mixed), min(len(span) // 8, 5),
                    min(int(4 * n_digits / len(span)), 3), int(variety(span) < 0.2))
        out.append(Candidate(kind, start, end, votes, features))
    return out


SIZES = (len(KINDS), 2, 2, 2, 6, 4, 2)


def one_hot(features: np.ndarray) -> np.ndarray:
    parts = [np.eye(size)[features[:, i]] for i, size in enumerate(SIZES)]
    return np.hstack([*parts, np.ones((len(features), 1))])


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability of each vote pattern being personal data; each labeler's reliability; the prior.

    The labelers' votes are taken as independent given the truth. ``votes`` holds 1, 0 and -1
    (no opinion), ``n`` how often each pattern occurs. Starts at the share of votes in favour.
    """
    given = votes >= 0
    p = (np.where(given, votes, 0).sum(1) + 0.5) / (given.sum(1) + 1)
    for _ in range(rounds):
        w1, w0 = (n * p)[:, None], (n * (1 - p))[:, None]
        yes1 = ((votes == 1) * w1).sum(0) + 1.6
        all1 = (given * w1).sum(0) + 2
        yes0 = ((votes == 1) * w0).sum(0) + 0.4
        all0 = (given * w0).sum(0) + 2
        a, b = yes1 / all1, yes0 / all0
        prior = ((n * p).sum() + 1) / (n.sum() + 2)
        log1 = np.log(prior) + np.where(votes == 1, np.log(a), np.where(votes == 0, np.log(1 - a), 0)).sum(1)
        log0 = np.log(1 - prior) + np.where(votes == 1, np.log(b), np.where(votes == 0, np.log(1 - b), 0)).sum(1)
        p, before = 1 / (1 + np.exp(np.clip(log0 - log1, -50, 50))), p
        if np.abs(p - before).max() < 1e-9:
            break
    return p, np.column_stack([a, b]), float(prior)


def logistic(x: np.ndarray, p: np.ndarray, n: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression on probabilities ``p`` seen ``n`` times (Newton's method)."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w)),
                               x.T @ (n * (p - q)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...] | None
    labelers: tuple[tuple[float, float], ...] = ()

    def keeps(self, found: list[Candidate]) -> list[bool]:
        if not found or self.weights is None:
            return [False] * len(found)
        x = one_hot(np.array([c.features for c in found]))
        return (x @ np.array(self.weights) > 0).tolist()


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Counts the vote and feature patterns of all candidates; there are few different ones, so
    both fits are on the driver. Without candidates no span is added."""
    own, = fresh(docs, "text_in")
    rows = docs.select(docs[text].cast("string").alias(own))

    def patterns(batches):
        counts: dict[tuple, int] = {}
        for batch in batches:
            for value in batch.column(own):
                for c in candidates(value.as_py() or ""):
                    key = (c.votes, c.features)
                    counts[key] = counts.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([list(v) for v, _ in counts], pa.list_(pa.int32())),
             pa.array([list(f) for _, f in counts], pa.list_(pa.int32())), pa.array(counts.values(), pa.int64())],
            ["votes", "features", "n"])

    found = (map_batches(rows, patterns, "votes array<int>, features array<int>, n long")
             .groupBy("votes", "features").agg(F.sum("n").alias("n")).orderBy("votes", "features").toArrow())
    if not found.num_rows:
        return Model(None)
    votes, features = (np.array(found.column(c).to_pylist()) for c in ("votes", "features"))
    n = found.column("n").to_numpy().astype(float)
    p, labelers, _ = reliabilities(votes, n)
    return Model(tuple(logistic(one_hot(features), p, n)), tuple(map(tuple, labelers)))


def spans(text: str, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: those added do not overlap any other."""
    base = base_spans(text)
    more = candidates(text)
    extra = []
    for c, keep in zip(more, model.keeps(more)):
        if keep and not any(c.start < b and a < c.end for _, a, b in base + extra):
            extra.append((c.kind, c.start, c.end))
    every = sorted(base + extra, key=lambda s: (KINDS.index(s[0]), s[1]))
    return base, every


def masked(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; of overlapping spans the union, by the first kind."""
    out, at = [], 0
    for kind, start, end in sorted(found, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])


def find(df: DataFrame, model: Model, text: str = "text", name: str = "spans") -> DataFrame:
    """``df`` with all spans of each text as structs (``kind``, ``start``, ``end`` in code points,
    ``base``). Null and empty texts have none; repeated rows are searched each."""
    own, = fresh(df, "text_in")
    kind = "array<struct<kind:string,start:int,end:int,base:boolean>>"
    rows = put(df.withColumn(own, df[text].cast("string")), name, F.lit(None).cast(kind))
    schema = rows.drop(own).schema

    def run(batches):
        for batch in batches:
            made = []
            for value in batch.column(own):
                base, every = spans(value.as_py() or "", model)
                known = set(base)
                made.append([{"kind": k, "start": a, "end": b, "base": (k, a, b) in known} for k, a, b in every])
            columns = [pa.array(made, pa.list_(SPAN)) if f == name else batch.column(f) for f in schema.names]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return map_batches(rows, run, schema)


def mask(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with each span of the text replaced by its kind in angle brackets; null stays null."""
    schema = df.withColumn(text, df[text].cast("string")).schema

    def run(batches):
        for batch in batches:
            made = [None if (t := v.as_py()) is None else masked(t, spans(t, model)[1]) for v in batch.column(text)]
            columns = [pa.array(made, pa.string()) if f == text else batch.column(f) for f in schema.names]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return map_batches(df.withColumn(text, df[text].cast("string")), run, schema)


@query("op6_pii")
def op6_pii(spark, sf_dir):
    """Spans of every document: counts of the base kinds, their digest, and all spans."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = find(docs, fit(docs)).drop("text")
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return out.select(
        "doc_id",
        *map(count, BASE),
        F.sha2(shown(base), 256).alias("base_sha256"), shown("spans").alias("spans"))
