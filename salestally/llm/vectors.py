"""Near duplicates among embeddings, by a graph index.

Vectors are dealt to the shards of their two nearest centres, so that shards
overlap. In each shard robust pruning leaves every vector a few neighbours that
lie in different directions, and the lists that a vector got in different
shards are united. A query goes to the nearest shards, walks greedily from the
shard's medoid to the vectors nearest to it, and spreads from these over all
neighbours within the range. What it finds is verified by exact cosine.

Links are counted where their other end has its first shard, so none counts
twice, and they leave a shard as counts and as a spanning forest, not as pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salestally.llm.common import map_batches, query, ship, table
from salestally.llm.graph import Forest, components, tie_all
from salestally.session import cut

COSINE = 0.95
SHARD = 2048  # vectors of a block; a shard with more has several, and queries visit all of them
TILE = 16_384  # queries that a block meets in one task
CENTRES = 4096  # at most
SAMPLE = 40_960  # vectors on which the centres are fitted at most
SHARDS_KEPT, SHARDS_ASKED = 2, 4  # per vector
DEGREE, POOL, BEAM = 24, 64, 24
SPREAD = 1.2  # a neighbour is dropped if another is so many times nearer to it
SLACK = 0.05  # spreading passes through vectors that are a little out of range


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; the largest component is divided out first, since squares can overflow or vanish."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True, initial=0)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def centres_of(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(3)
    out = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(part @ out.T).argmax(1) for part in np.array_split(sample, len(sample) // 4096 + 1)])
        sums = np.zeros_like(out)
        np.add.at(sums, near, sample)
        full = np.linalg.norm(sums, axis=1) > 0
        out[full] = unit(sums[full])
    return out


def prune(pool: np.ndarray, near: np.ndarray, vectors: np.ndarray, degree: int = DEGREE) -> list[int]:
    """Robust pruning of candidates given nearest first, with their distances to the node."""
    inner = np.sqrt(np.maximum(2 - 2 * vectors[pool] @ vectors[pool].T, 0))
    alive, kept = np.ones(len(pool), bool), []
    while alive.any() and len(kept) < degree:
        i = int(alive.argmax())
        kept.append(int(pool[i]))
        alive &= SPREAD * inner[i] > near
        alive[i] = False
    return kept


def build(vectors: np.ndarray) -> list[list[int]]:
    """Neighbours of each vector of a block, pruned from its nearest ones and some chosen at random.

    Edges go both ways, and where pruning left near duplicates apart the nearest is put back.
    """
    n = len(vectors)
    rng = np.random.default_rng(n)
    out: list[set[int]] = [set() for _ in range(n)]
    whole, back = Forest(n), []
    for start in range(0, n, 512):
        sims = vectors[start:start + 512] @ vectors.T
        sims[np.arange(len(sims)), np.arange(start, start + len(sims))] = -2
        k = min(POOL, n - 1)
        pools = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(sims), 0), int)
        for i, pool in enumerate(pools, start):
            pool = np.unique(np.r_[pool, rng.integers(0, n, 8)])
            pool = pool[pool != i]
            s = sims[i - start][pool]
            order = np.argsort(-s, kind="stable")
            pool, s = pool[order], s[order]
            kept = prune(pool, np.sqrt(np.maximum(2 - 2 * s, 0)), vectors)
            out[i].update(kept)
            back.append((i, pool[s >= COSINE - SLACK]))
    for i, neighbours in enumerate([list(o) for o in out]):
        whole.tie(i, neighbours)
        for j in neighbours:
            if len(out[j]) < 2 * DEGREE:
                out[j].add(i)
    close = Forest(n)
    for i in range(n):
        close.tie(i, [j for j in out[i] if vectors[i] @ vectors[j] >= COSINE - SLACK])
    for i, pool in back:  # keep what is close connected among itself
        for j in pool.tolist():
            if close.root(i) != close.root(j):
                close.tie(i, [j])
                out[i].add(j)
                out[j].add(i)
    for i in range(1, n):  # and all in one piece
        if whole.root(i) != whole.root(0):
            whole.tie(0, [i])
            out[0].add(i)
            out[i].add(0)
    return [sorted(o) for o in out]


def search(q: np.ndarray, vectors: np.ndarray, graph: list[np.ndarray], start: int) -> np.ndarray:
    """Places of the vectors found in range of ``q``."""
    seen = np.zeros(len(vectors), bool)
    places, sims = np.array([start]), vectors[[start]] @ q
    seen[start] = True
    done: set[int] = set()
    while True:
        todo = [p for p in places[np.argsort(-sims)[:BEAM]].tolist() if p not in done][:4]
        if not todo:
            break
        done.update(todo)
        new = np.unique(np.concatenate([graph[p] for p in todo]))
        new = new[~seen[new]]
        seen[new] = True
        places, sims = np.r_[places, new], np.r_[sims, vectors[new] @ q]
        if len(places) > 4 * BEAM:
            best = np.argsort(-sims)
            wide = int((sims >= COSINE - SLACK).sum())
            best = best[:max(2 * BEAM, wide)]
            places, sims = places[best], sims[best]
    inside = sims >= COSINE - SLACK
    found, front = [places[sims >= COSINE]], places[inside]
    while len(front):
        new = np.unique(np.concatenate([graph[p] for p in front.tolist()]))
        new = new[~seen[new]]
        seen[new] = True
        s = vectors[new] @ q
        found.append(new[s >= COSINE])
        front = new[s >= COSINE - SLACK]
    return np.concatenate(found)


def as_matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


class Index:
    """``links`` of all vectors of ``distinct`` (``id``, ``weight``: its copies, itself included, and ``vector``,
    finite and not zero)."""

    def __init__(self, distinct: DataFrame):
        ship(distinct.sparkSession)
        self.rows = distinct
        n = distinct.count()
        bound = 1 << 30  # about SAMPLE vectors by hash, so that no task gathers those of all others
        taken = distinct.where(F.pmod(F.xxhash64("id"), F.lit(bound)) < F.lit(int(bound * min(1.0, SAMPLE / max(n, 1)))))
        sample = taken.select("vector").limit(2 * SAMPLE).toArrow()
        if n and not sample.num_rows:
            sample = distinct.select("vector").limit(1).toArrow()
        self.dim = len(sample["vector"][0]) if n else 0
        k = min(CENTRES, max(1, round(2 * n / SHARD)))
        self.centres = centres_of(unit(as_matrix(sample["vector"])), k) if n else np.zeros((0, 0))
        self.dealt = cut(self._deal(), "vector-shards")
        kept = F.count_if(F.col("rank") < SHARDS_KEPT).alias("n")
        sizes = self.dealt.groupBy("shard").agg(kept, F.count("id").alias("asked")).toArrow()  # a row per shard
        blocks, tiles = (np.ones(max(len(self.centres), 1), int) for _ in range(2))
        for shard, size, asked in zip(*(sizes[c].to_pylist() for c in ("shard", "n", "asked"))):
            blocks[shard], tiles[shard] = max(1, -(-size // SHARD)), -(-asked // TILE)
        own = lambda numbers: F.element_at(F.array(*[F.lit(int(b)) for b in numbers]), F.col("shard") + 1)
        self.placed = (self.dealt.withColumn("blocks", own(blocks)).withColumn("tiles", own(tiles))
                       .withColumn("home", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
        self.graph = cut(self._build(), "vector-graph")

    def _deal(self) -> DataFrame:
        centres, kept = self.centres, min(SHARDS_ASKED, len(self.centres))

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = unit(as_matrix(batch.column("vector")))
                near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :kept]
                values = pa.array(list(x), pa.list_(pa.float64()))
                for rank in range(kept):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(near[:, rank], pa.int32()), pa.array([rank] * len(x), pa.int32()), batch.column("id"),
                         batch.column("weight"), values], ["shard", "rank", "id", "weight", "vector"])

        return map_batches(self.rows, run, "shard int, rank int, id long, weight long, vector array<double>")

    def _build(self) -> DataFrame:
        """Every vector's neighbours, united over its shards."""
        def run(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("id")
            ids = rows["id"].to_numpy()
            graph = build(as_matrix(rows["vector"]))
            return pa.table({"id": ids, "near": pa.array([ids[g] for g in graph], pa.list_(pa.int64()))})

        kept = self.placed.where(F.col("rank") < SHARDS_KEPT).select("shard", "home", "id", "vector")
        parts = kept.groupBy("shard", "home").applyInArrow(run, "id long, near array<long>")
        return parts.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))

    def links(self) -> DataFrame:
        """Per block a row for each vector that has links in it: ``id``, ``n`` (other vectors, copies
        counted) and ``tied``, vectors linked with it that keep the block's links connected."""
        graph = self.graph.withColumnRenamed("id", "g_id")
        data = self.placed.where(F.col("rank") < SHARDS_KEPT).join(graph, F.col("id") == F.col("g_id")).drop("g_id")
        # a block meets the queries of its shard tile by tile, so that neither side of a group grows with the shard
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        data = data.withColumn("block", F.col("home")).withColumn("tile", each("tiles"))
        asked = self.placed.withColumn("tile", F.pmod(F.xxhash64("id", F.lit(1)), F.col("tiles")).cast("int")).withColumn(
            "block", each("blocks")).withColumn("near", F.lit(None).cast("array<long>"))
        columns = ["shard", "block", "tile", "rank", "id", "weight", "vector", "near"]

        def run(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by([("id", "ascending"), ("rank", "ascending")])
            is_data = np.array(rows["near"].is_valid())
            data, asked = rows.filter(is_data), rows.filter(~is_data)
            out: dict[str, list] = {"id": [], "n": [], "tied": []}
            if data.num_rows:
                ids, x, weight = data["id"].to_numpy(), as_matrix(data["vector"]), data["weight"].to_numpy()
                first = data["rank"].to_numpy() == 0
                place = {int(v): i for i, v in enumerate(ids)}
                graph = [np.array([place[v] for v in near if v in place], np.int64) for near in data["near"].to_pylist()]
                medoid = int((x @ x.sum(0)).argmax())
                q_ids, q = asked["id"].to_numpy(), as_matrix(asked["vector"])
                outside = [int(v) for v in q_ids if int(v) not in place]
                number = place | {v: len(ids) + i for i, v in enumerate(outside)}
                names = np.r_[ids, np.array(outside, np.int64)]
                forest, counted = Forest(len(names)), {}
                for own, vector in zip(q_ids.tolist(), q):
                    found = search(vector, x, graph, medoid)
                    found = found[first[found] & (ids[found] != own)]
                    if len(found):
                        counted[number[own]] = int(weight[found].sum())
                        forest.tie(number[own], found)
                tied: dict[int, list[int]] = {}
                for a, b in forest.edges:
                    tied.setdefault(a, []).append(int(names[b]))
                out = {"id": [int(names[a]) for a in counted], "n": list(counted.values()),
                       "tied": [tied.get(a, []) for a in counted]}
            return pa.table({"id": pa.array(out["id"], pa.int64()), "n": pa.array(out["n"], pa.int64()),
                             "tied": pa.array(out["tied"], pa.list_(pa.int64()))})

        every = data.select(*columns).union(asked.select(*columns))
        return every.groupBy("shard", "block", "tile").applyInArrow(run, "id long, n long, tied array<long>")


def few_links(distinct: DataFrame) -> DataFrame:
    """``links`` of vectors whose length at most ``SHARD`` of them have: all of a length are compared."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        ids, weight, x = rows["id"].to_numpy(), rows["weight"].to_numpy(), unit(as_matrix(rows["vector"]))
        link = x @ x.T >= COSINE
        np.fill_diagonal(link, False)
        forest = Forest(len(ids))
        tie_all(forest, link)
        tied: dict[int, list[int]] = {}
        for a, b in forest.edges:
            tied.setdefault(a, []).append(int(ids[b]))
        some = np.flatnonzero(link.any(axis=1))
        return pa.table({"id": pa.array(ids[some]), "n": pa.array((link @ weight)[some], pa.int64()),
                         "tied": pa.array([tied.get(i, []) for i in some.tolist()], pa.list_(pa.int64()))})

    return distinct.groupBy("k").applyInArrow(run, "id long, n long, tied array<long>")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per row of ``df``: its key, ``n_links``, ``component_id`` and ``kept``.

    Equal vectors are searched once and count as linked. Null, empty, zero and non-finite vectors
    have no links; vectors link with those of their own length. Repeated keys stay apart in
    ``n_links`` and share a component; rows with a null key have none. An empty table gives an
    empty table; further columns are not looked at, so none can clash.

    Each length that more than ``SHARD`` vectors have gets an index of its own; there are at most as
    many as the table has shards. Vectors of rarer lengths are compared with all of their length.
    """
    rows = df.select(df[key].cast("long").alias("id"), df[vector].cast("array<double>").alias("v"))
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = fine & F.exists("v", lambda x: x != 0) & F.col("id").isNotNull()
    rows = rows.withColumn("v", F.when(F.coalesce(fine, F.lit(False)), F.col("v")))
    known = cut(rows.where("v is not null").groupBy(F.col("v").alias("vector")).agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")).withColumn("k", F.size("vector")), "vectors")
    member = rows.where("v is not null").join(known, F.col("v") == F.col("vector"))
    member = cut(member.select(rows["id"].alias("m_id"), known["id"].alias("class_id"), "weight"), "vector-classes")
    sizes = known.groupBy(F.col("k").alias("length")).count()
    large = [r.length for r in sizes.where(F.col("count") > SHARD).orderBy("length").collect()]
    few = known.join(sizes.where(F.col("count") <= SHARD), F.col("k") == F.col("length"), "left_semi")
    links = few_links(few)
    for length in large:
        links = links.union(Index(known.where(F.col("k") == length).drop("k")).links())
    found = cut(links, "vector-links")
    n = found.groupBy("id").agg(F.sum("n").alias("n")).withColumnRenamed("id", "n_id")
    parts = components(found.select(F.col("id").alias("a"), F.explode("tied").alias("b")))
    out = member.join(n, F.col("class_id") == F.col("n_id"), "left").join(parts, F.col("class_id") == F.col("node"), "left")
    linked = out.select("m_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                        F.coalesce("component", "class_id").alias("component_id"))
    alone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    both = linked.union(alone)
    return both.select(F.col("m_id").alias(key), "n_links", "component_id",
                       F.coalesce(F.col("m_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def audit(df: DataFrame, result: DataFrame, key: str = "vec_id", vector: str = "embedding") -> float:
    """Share of the true links that were found, for vectors whose key is divisible by 20: compared
    with all vectors, block by block."""
    asked = df.where(F.col(key) % 20 == 0).select(key, vector).toArrow()
    ids, q = asked[key].to_numpy(), unit(as_matrix(asked[vector]))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                hit = (q @ unit(as_matrix(batch.column(vector))).T >= COSINE) & (ids[:, None] != batch.column(key).to_numpy()[None])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hit.sum(1))], ["a_id", "n"])

    true = map_batches(df.select(key, vector), run, "a_id long, n long").groupBy("a_id").agg(F.sum("n").alias("n"))
    both = true.join(result, F.col("a_id") == F.col(key)).agg(F.sum("n_links"), F.sum("n")).first()
    return both[0] / both[1] if both[1] else 1.0


@query("op9_embedding_duplicates")
def op9_embedding_duplicates(spark, sf_dir):
    """All vectors with their links of cosine 0.95 or more."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
