"""Near copies, repeated strings, near vectors and the pipeline against plain versions."""

import hashlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from salestally.llm import QUERIES, bpe, graph, jaccard, pii, repeats, rules, vectors
from rows import odd_rows, prose


def shingles(text):
    words = (text or "").encode().split()
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def linked(items, link):
    """Components by the plain way: least index reachable."""
    up = list(range(len(items)))
    for _ in items:
        for i in range(len(items)):
            for j in range(len(items)):
                if i != j and link[i][j]:
                    up[i] = up[j] = min(up[i], up[j])
    return up


def plain_join(rows):
    sets = [shingles(t) for _, t in rows]
    link = [[i != j and bool(a) and bool(b) and 5 * len(a & b) >= 4 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    up = linked(rows, link)
    ids = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        ids[up[i]].append(key)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return [(key, least[up[i]], sum(link[i])) for i, (key, _) in enumerate(rows)]


def near_copies():
    out = []
    for group in range(6):
        base = prose(group, 220).split(" ")
        for copy in range(9):
            words = list(base)
            for k in range(copy * 2):
                words[(31 * k + 7 * copy) % 200] = f"w{group}x{copy}x{k}"
            out.append((group * 100 + copy, " ".join(words)))
    return out


@pytest.mark.parametrize("tile", [1024, 4])
def test_jaccard_join(spark, odd, tile):
    for rows in (near_copies(), [(r[0], r[1]) for r in odd_rows()]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        found = jaccard.similar(df, tile=tile).collect()
        assert Counter(map(tuple, found)) == Counter(plain_join(rows))
    kept = jaccard.one_of_each(odd, tile=tile)
    assert kept.columns == odd.columns
    # one row of a group: the one whose key names it; texts without words have no group and stay
    want = Counter()
    for (key, group, _), row in zip(plain_join([(r[0], r[1]) for r in odd_rows()]), odd_rows()):
        if not shingles(row[1]):
            want[(key, row[1])] += 1
        elif key == group:
            want[(key, row[1])] = 1
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want


def test_join_of_other_columns(clashing, none):
    assert jaccard.similar(clashing).count() == len(odd_rows())
    assert jaccard.one_of_each(clashing).columns == clashing.columns
    assert jaccard.similar(none).collect() == [] and jaccard.one_of_each(none).collect() == []


def test_pruning_drops_what_is_improbable_only():
    for n in (20, 60, 180):
        m = jaccard.least_matches(n)
        draws = np.random.default_rng(n).binomial(n, 0.8, 200_000)
        assert (draws < m).sum() == 0 and m > n // 8
    a = np.arange(180)[None]
    assert jaccard.surviving(a, a, np.ones((1, 1), bool)).all() and not jaccard.surviving(a, a + 1, np.ones((1, 1), bool)).any()


def test_verification_is_exact():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 30, rng.integers(1, 30)).astype(np.uint64)) for _ in range(60)]
    for t in (Fraction(4, 5), Fraction(1, 3)):
        want = np.array([[len(np.intersect1d(a, b)) * t.denominator >= len(np.union1d(a, b)) * t.numerator for b in sets] for a in sets])
        assert (jaccard.verified(sets, sets, np.ones((60, 60), bool), t) == want).all()


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (230, 2))] + [(1000 + i, 1001 + i) for i in range(120)] + [(7, 7)]
    found = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    nodes = sorted({x for e in edges for x in e})
    up = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert all(found.get(n, n) == up[n] for n in nodes)
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- repeated strings

def plain_repeats(texts):
    count = Counter(b[i:i + 200] for b in texts for i in range(len(b) - 199))
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if count[b[i:i + 200]] > 1:
                gone[i:i + 200] = True
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
        out.append((len(b), tuple(map(tuple, edges.reshape(-1, 2).tolist())), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize("bucket", [repeats.BUCKET, 1])
def test_repeats(spark, odd, clashing, none, bucket):
    period = ("abc" * 300)[:-1]
    more = [(900, period), (901, "x" + period[:400]), (902, "é" * 150), (903, "é" * 99), (904, prose(2, 60) + "z" + prose(2, 60))]
    rows = [(r[0], r[1]) for r in odd_rows()] + more
    for df in (spark.createDataFrame(rows, "doc_id long, text string").repartition(4), clashing):
        texts = [(r.doc_id, (r.text or "").encode()) for r in df.select("doc_id", "text").collect()]
        want = Counter((key, *x) for (key, _), x in zip(texts, plain_repeats([b for _, b in texts])))
        found = Counter((r.doc_id, r.n_bytes, tuple(map(tuple, r.spans)), bytes(r.left))
                        for r in repeats.without_repeats(df, bucket=bucket).collect())
        assert found == want
    assert repeats.without_repeats(none).collect() == []


def test_repeats_of_the_query(spark, folder):
    rows = QUERIES["op8_suffix_dedup"](spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: (n, len(s), hashlib.sha256(left).hexdigest())
            for d, (n, s, left) in zip(docs, plain_repeats([(d.text or "").encode() for d in docs]))}
    assert {r.doc_id: (r.n_bytes, r.n_spans, r.kept_sha256) for r in rows} == want


# --- vectors

def plain_links(rows):
    good = [v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and k is not None for k, v in rows]
    whole = [np.array([Fraction(x) for x in v], object) if g else None for (_, v), g in zip(rows, good)]
    big = [max(abs(x) for x in w) if g else None for w, g in zip(whole, good)]
    unit = [np.array([float(x / b) for x in w]) if g else None for w, b, g in zip(whole, big, good)]
    unit = [u / np.linalg.norm(u) if g else None for u, g in zip(unit, good)]
    link = [[i != j and good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95 for j in range(len(rows))] for i in range(len(rows))]
    up = linked(rows, link)
    groups = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        groups[up[i]].append(k)
    return Counter((k, sum(link[i]), min((x for x in groups[up[i]] if x is not None), default=None)) for i, (k, _) in enumerate(rows))


@pytest.mark.parametrize("shard, tile", [(vectors.SHARD, vectors.TILE), (40, 25)])
def test_vectors(spark, monkeypatch, shard, tile):
    monkeypatch.setattr(vectors, "SHARD", shard)
    monkeypatch.setattr(vectors, "TILE", tile)
    rng = np.random.default_rng(1)
    rows = []
    for group in range(12):
        centre = rng.normal(size=8)
        rows += [(len(rows) + k, (centre + rng.normal(size=8) * 0.05).tolist()) for k in range(group)]
    rows += [(500 + k, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]) for k in range(15)]
    rows += [(600, None), (601, [0.0] * 8), (602, [1.0, None] * 4), (603, [float("nan")] * 8), (604, [float("inf")] * 8),
             (605, [1.0]), (None, [1.0] * 8), (606, [-1.0] * 8), (606, [-1.0] * 8), (607, [])]
    # another length; squares that overflow and that vanish
    rows += [(700, [2.0]), (701, [-3.0]), (702, [1e200, 2e200]), (703, [2e200, 4e200]), (704, [1e-200, 2e-200]), (705, [3.0, 1.0]), (706, [5e-324, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit(1)).withColumn("kept", F.lit(1))
    found = vectors.near_duplicates(df)
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in found.collect()) == plain_links(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.where("vec_id is not null").collect())
    assert vectors.near_duplicates(df.where("false")).collect() == []


def test_recall_of_the_index(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    assert vectors.audit(df, vectors.near_duplicates(df)) >= 0.9


def test_pruned_neighbours_lie_in_different_directions():
    points = vectors.unit(np.array([[1, 0.0], [1, 0.1], [1, 0.2], [1, -0.1]]))
    near = np.linalg.norm(points[1:] - points[0], axis=1)
    order = np.argsort(near)
    assert sorted(vectors.prune(1 + order, near[order], points)) == [1, 3]


# --- pipeline

def test_pipeline(spark, odd, tmp_path):
    docs = corpus_pipeline.documents(spark, "/root/testdata/sf0.001")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "jaccard_join", "pii", "mixing", "bpe"]
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.cut(stage(spark, now, ""), "test")
        seen[name] = now.collect()
        if name != "bpe":
            assert now.columns == docs.columns
    kept = {r.row.doc_id for r in rules.judge(docs).collect() if r.kept}
    assert {r.doc_id for r in seen["quality_rules"]} == kept
    groups = plain_join([(r.doc_id, r.text) for r in seen["quality_rules"]])
    assert {r.doc_id for r in seen["jaccard_join"]} == {g for _, g, _ in groups}
    text = {r.doc_id: r.text for r in seen["jaccard_join"]}
    for r in seen["pii"]:
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
        assert pii.base_spans(text[r.doc_id]) or "<" in r.text or r.text == text[r.doc_id]
    pieces = {r.doc_id: r.text for r in seen["pii"]}
    assert all(pieces[r.doc_id] == r.text for r in seen["mixing"]) and max(Counter(r.doc_id for r in seen["mixing"]).values()) <= 2
    vocabulary = bpe.vocabulary(bpe.default_tokenizer())
    assert Counter(r.doc_id for r in seen["bpe"]) == Counter(r.doc_id for r in seen["mixing"])
    for r in seen["bpe"]:
        assert r.round_trip and vocabulary.decode(bytes(r.ids)) == pieces[r.doc_id]


def test_stages_on_odd_tables(spark, odd, none, clashing):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").collect() == []
        stage(spark, odd, "").collect()
        out = stage(spark, clashing, "")
        out.collect()
        assert name == "bpe" or out.columns == clashing.columns
