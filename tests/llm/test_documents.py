"""Mixing, quality, rules, personal data and language-model scores against plain versions, and on odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import connect, rows_of
from salestally.llm import QUERIES, SQL, lm, mixing, pii, quality, rules
from rows import odd_rows, prose

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_gives_the_same_rows(spark, folder, name):
    df = QUERIES[name](spark, folder)
    cursor = connect(folder).execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


# --- mixing

def test_targets_reshare():
    found = {t.source: t.target for t in mixing.targets({"a": 10, "b": 1000, None: 1000}, {"a": 5, "b": 2, None: 1})}
    assert found["a"] == 20 and found["b"] == pytest.approx((3015 - 20) * 2 / 3)
    assert sum(found.values()) == pytest.approx(3015)


def test_mix_comes_near_its_targets(odd, clashing):
    for df in (odd, clashing):
        mix = mixing.Mix(df)
        rows = mix.taken(mix.keyed).collect()
        assert len(rows) == len(odd_rows())
        for source in {r.source for r in rows}:
            own = [r for r in rows if r.source == source]
            taken = sum(r.mix_size * r.mix_copies for r in own)
            assert abs(taken - own[0].target) <= max(r.mix_size for r in own) * 2 / 2 + 1e-6
            assert all(r.mix_copies <= 2 for r in own)
        again = mixing.Mix(df)
        assert Counter(again.taken(again.keyed).collect()) == Counter(rows)
        assert mix.documents(df).columns == df.columns
        assert mix.documents(df).count() == sum(r.mix_copies for r in rows)


def test_few_buckets_cut_at_the_same_place(odd):
    one, many = mixing.Mix(odd, buckets=1), mixing.Mix(odd)
    pick = lambda m: Counter(m.taken(m.keyed).select("doc_id", "source", "mix_copies").collect())
    assert pick(one) == pick(many)


def test_mix_of_nothing(none):
    mix = mixing.Mix(none)
    assert mix.documents(none).collect() == [] and mix.taken(mix.keyed).collect() == []


def test_too_many_sources(odd, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    with pytest.raises(ValueError):
        mixing.Mix(odd)


# --- quality

def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    scores = QUERIES["op4_quality"](spark, folder).toPandas()
    assert scores.score.between(0, 1).all() and len(scores) == 1000
    both = scores.merge(spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.quality).mean() > 0.9


def test_quality_odd_rows(spark, odd, clashing, none):
    labels = spark.createDataFrame([(4, 1), (4, 0), (7, None), (None, 1), (16, 0), (20, 1)], "doc_id long, quality int")
    for df in (odd, clashing):
        out = quality.classify(df, labels, F.lit(None).cast("boolean")).collect()
        assert len(out) == len(odd_rows()) and all(0 <= r.score <= 1 for r in out)
    empty = labels.where("false")
    assert {r.score for r in quality.classify(odd, empty, F.lit(False)).collect()} == {0.5}
    assert quality.classify(none, labels, F.lit(False)).collect() == []


def test_normal_equations_are_the_sums_of_parts(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(50, len(quality.STATISTICS))), rng.integers(0, 2, 50)
    rows = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y)], "statistics array<double>, y double").repartition(5)
    model = quality.Model(np.zeros(x.shape[1]), np.ones(x.shape[1]))
    a, b = quality._sums(rows, model)
    z = model.features(x)
    assert np.allclose(a, z.T @ z) and np.allclose(b, z.T @ y)


def test_pooling_is_isotonic():
    n, y = np.array([2.0, 1, 1, 3]), np.array([1.0, 1, 0, 3])
    assert np.allclose(quality._pool(n, y), [0.5, 0.5, 0.5, 1])


def test_random_features_approximate_a_gaussian_kernel():
    x = np.random.default_rng(1).normal(size=(20, 17)) / 2
    model = quality.Model(np.zeros(17), np.ones(17))
    z = model.features(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 2 / 17 / quality.WIDTH**2)
    assert np.abs(z @ z.T - kernel).max() < 0.35


# --- rules

def plain_counts(text):
    words = [w.decode() for w in WORDS.findall((text or "").encode())]
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x.encode())]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rules(odd, clashing, none):
    for df in (odd, clashing):
        out = rules.judge(df).collect()
        assert Counter(r.row.doc_id for r in out) == Counter(r[0] for r in odd_rows())
        for r in out:
            counts = plain_counts(r.row.text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
            assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
            if r.row.source == "hub":
                assert r.n_removed_lines == 1 and r.kept
    assert rules.judge(none).collect() == []


def test_depleted_documents_go_and_copies_stay(spark):
    shared = "\n".join(prose(k, 40).replace("\n", " ") for k in range(4))
    rows = [(i, f"{shared}\n{prose(900 + i, 600)}", "s") for i in range(25)]
    rows += [(50, f"{shared}\n{prose(7, 15)}", "s"), (51, shared, "s")]  # little or nothing of their own
    rows += [(100 + i, prose(5, 200), "s") for i in range(40)]  # copies of one text
    rows += [(200, prose(6, 200), "s")]
    out = {r.row.doc_id: r for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(out[i].kept or out[i].base_failed for i in (50, 51))
    assert all(out[i].kept for i in [*range(25), *range(100, 140), 200])


def test_hosts_of_footers(spark):
    """Footers go though they are most of their documents, and copies beside them change nothing."""
    footer = "\n".join(" ".join(f"f{k}x{i}" for i in range(40)) for k in range(12))
    own = lambda i: " ".join(f"own{i}x{j}" for j in range(40))
    for n, copies in ((200, 0), (100, 300)):
        rows = [(i, f"{own(i)}\n{footer}", "h") for i in range(n)] + [(10_000 + i, prose(5, 200), "h") for i in range(copies)]
        rows += [(20_000, prose(9, 300) + "\n" + footer.split("\n")[0] + "\nend", "h"), (20_001, footer, "other")]
        out = rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), clean=True).collect()
        kept = {r.row.doc_id: r for r in out if r.kept}
        assert sorted(kept) == [*range(10_000, 10_000 + copies), 20_000, 20_001]
        assert kept[20_000].left == prose(9, 300) + "\nend" and kept[20_000].n_removed_lines == 1
        assert all(r.left == r.row.text for k, r in kept.items() if k != 20_000)
        assert all(r.left == own(r.row.doc_id) and r.n_removed_lines == 12 for r in out if r.row.doc_id < n)


def test_rules_run_no_python(spark, folder):
    plan = QUERIES["op5_quality_rules"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
OTHERS = {"ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    for kind, pattern in OTHERS.items():
        for m in re.finditer(pattern, text):
            n = [int(c) for c in m.group() if c.isdigit()]
            double = [2 * d - 9 * (2 * d > 9) for d in n[-2::-2]]
            fine = {"ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                    "card": lambda: 16 <= len(n) <= 19 and (sum(n[-1::-2]) + sum(double)) % 10 == 0, "phone": lambda: 8 <= len(n) <= 15}
            if fine[kind]():
                out.append((kind, *m.span()))
    return out


def test_base_spans_are_those_of_the_patterns():
    import random

    rng = random.Random(4)
    for alphabet in ("ab@.- é", "0123. +-()", "04 -", "1+ ()5.@a"):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 45)))
            assert pii.base_spans(text) == plain_spans(text), text


def test_personal_data(odd, clashing, none, folder, spark):
    model = pii.fit(spark.read.parquet(f"{folder}/documents.parquet"))
    for df in (odd, clashing):
        for r in pii.find(df, model).select("text", "spans").collect():
            assert [(s.kind, s.start, s.end) for s in r.spans if s.base] == plain_spans(r.text or "")
        assert pii.mask(df, model).columns == df.columns
    text, = (r.text for r in pii.mask(odd, model).where("doc_id = 15").collect())
    assert text == 'mail <email> or <phone>, <ip>, <card>; token = "<secret>"'
    assert pii.mask(odd, model).where("doc_id = 1").first().text is None
    assert pii.find(none, pii.fit(none)).collect() == [] and pii.fit(none).weights is None


def test_secrets_of_any_length(spark):
    """Long tokens and keys are taken whole."""
    token, key = "aB3" * 130 + "x9", "A1B2C3D4" * 8
    for text, kind, span in ((f"token={token} end", "secret", token), (f'secret: "{token}" end', "secret", token), (f"use {key} now", "key", key)):
        found = [c for c in pii.candidates(text) if c.kind == kind]
        assert [text[c.start:c.end] for c in found] == [span]
    rows = [(i, f"token={token[i:]} end") for i in range(40)] + [(100 + i, f"see key: {'plainword' * (i % 4 + 1)} there") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {r.doc_id: r.text for r in pii.mask(df, pii.fit(df)).collect()}
    assert all(texts[i] == "token=<secret> end" for i in range(40))


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "@" * 100_000, "+1" * 100_000, "1." * 100_000):
        pii.base_spans(text)
        pii.candidates(text)


def test_reliabilities_follow_the_truth():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    votes = np.column_stack([np.where(rng.random(4000) < right, truth, ~truth) for right in (0.95, 0.8, 0.7)]).astype(int)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    p, labelers, prior = pii.reliabilities(patterns, n.astype(float))
    assert abs(prior - 0.4) < 0.05 and abs(labelers[0, 0] - 0.95) < 0.05 and abs(labelers[1, 0] - 0.8) < 0.05


# --- language model

@pytest.mark.parametrize("order", [1, 3, 4])
def test_longer_orders_against_a_plain_version(odd, order):
    texts = [[w for w in re.split(r"[\x20\x09-\x0D]+", r[1] or "") if w] for r in odd_rows() if r[0] != 7]
    counts = [Counter(tuple(w[i:i + k]) for w in texts for i in range(len(w) - k + 1)) for k in range(1, order + 1)]
    total = sum(map(len, texts))
    want = Counter()
    for w in texts:
        own = [Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) for k in range(1, order + 1)]
        other = lambda g: counts[len(g) - 1][g] - own[len(g) - 1][g]
        score = 0.0
        for i in range(len(w)):
            k, penalty = min(order, i + 1), 0.0
            while k > 1 and other(tuple(w[i - k + 1:i + 1])) <= 0:
                k, penalty = k - 1, penalty + math.log(0.4)
            g = tuple(w[i - k + 1:i + 1])
            score += penalty + (math.log(max(other(g), 1) / max(total - len(w), 1)) if k == 1 else math.log(other(g) / other(g[:-1])))
        want[(len(w), round(score, 6))] += 1
    for block in (lm.BLOCK, 3000):
        out = lm.score(odd.where("doc_id is null or doc_id <> 7"), order=order, block=block).collect()
        assert Counter((r.lm_words, round(r.lm_log_score, 6)) for r in out) == want


def test_scores_of_odd_tables(clashing, none):
    assert lm.score(clashing).count() == len(odd_rows())
    assert lm.score(none).collect() == []


def test_planes():
    numbers = np.array([0, 1, 2**40 + 5, 2**64 - 1], np.uint64)
    assert (lm.unplanes(lm.planes(numbers)) == numbers).all()
