"""Hard negatives of anchors, by angles to reference directions.

Vectors become whole numbers and are stored with their norms and their angles to a few
reference directions. For two vectors whose angles to one direction are s and t, the angle
between them is at least |s - t| and at most s + t, so the stored angles give an interval for
their cosine, and with the norms for their inner product. Vectors are laid out by their nearest
direction and the angle to it, in blocks of windows that hold like vectors. Tiles of anchors
meet the blocks whose bounds allow a wanted score, and of those only the windows whose bounds
overlap what an anchor looks for are multiplied out, in whole numbers.

The first pass finds the positives, above what an anchor's own block gives; the second one the
negatives, inside the windows of scores that the positives set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salestally.llm.common import map_batches, query, ship, table
from salestally.session import cut

SCALE = 256  # a component x becomes floor(SCALE * x)
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # a negative's score in hundredths of the positive's
ANCHOR_EVERY, SHIFT_EVERY, LABELS = 50, 7, 10
REFERENCES = 16
SAMPLE = 2048  # about so many vectors are taken by hash for the choice of the directions
WINDOW, BLOCK, TILE = 128, 4096, 1024
WIDE = 2.0 ** 26  # from this norm on, products are made of Python's integers
SLACK = 1e-6  # radians by which an angle may be off
LEAST, MOST = -(1 << 63), (1 << 63) - 1


# --- reference directions ---------------------------------------------------------------


def unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True, initial=0)
    x = x / np.where(big > 0, big, 1)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def directions(sample: np.ndarray, k: int = REFERENCES, rounds: int = 6) -> np.ndarray:
    """Spherical k-means, begun from vectors that lie far apart."""
    x = unit(sample)
    out = x[:1]
    near = x @ out[0]
    for _ in range(min(k, len(x)) - 1):
        out = np.r_[out, x[[int(near.argmin())]]]
        near = np.maximum(near, x @ out[-1])
    for _ in range(rounds):
        own = (x @ out.T).argmax(1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, x)
        full = np.linalg.norm(sums, axis=1) > 1e-9
        out[full] = unit(sums[full])
    return out


def references(rows: DataFrame) -> dict[int, np.ndarray]:
    """Directions for every length of vector that the sample holds."""
    n = rows.count()
    bound = 1 << 30
    taken = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(bound)) < F.lit(int(bound * min(1.0, SAMPLE / max(n, 1)))))
    vectors = [np.array(v, float) for v in taken.select("v").limit(4 * SAMPLE).toArrow()["v"].to_pylist()]
    sizes = {len(v) for v in vectors}
    return {size: directions(np.array([v for v in vectors if len(v) == size])) for size in sizes if size}


# --- stored rows -----------------------------------------------------------------------------


def participants(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``vec_id``, ``label`` and ``v`` of the rows that take part, labels shifted where the id says so."""
    rows = df.select(df[key].cast("long").alias("vec_id"), df[label].cast("long").alias("label"), df[vector].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    shifted = F.when(F.col("vec_id") % SHIFT_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return rows.withColumn("label", shifted)


def whole(v: np.ndarray) -> list[int]:
    """The vector in Python's integers, exact for every finite number."""
    out = []
    for x in v.tolist():
        a, b = x.as_integer_ratio()
        out.append(SCALE * a // b)
    return out


def as_rows(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


STORED = "vec_id long, label long, size int, home int, angle double, norm double, wide boolean, angles binary, q binary"


def stored(rows: DataFrame, known: dict[int, np.ndarray]) -> DataFrame:
    """Every vector in whole numbers with its norm, its nearest direction and its angles to all.

    A wide vector, whose norm lets products leave the exact range of doubles, keeps its own numbers.
    """
    def run(batches):
        for batch in batches:
            lengths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == size))
                x = as_rows(part.column("v"), size)
                refs = known.get(size, np.ones((1, size)) / max(size, 1) ** 0.5)
                wide = np.abs(x).max(axis=1, initial=0) * SCALE * max(size, 1) ** 0.5 >= WIDE
                q = np.floor(np.where(wide[:, None], 0, x) * SCALE)
                u = unit(np.where(wide[:, None], x, q))
                cosines = np.clip(u @ refs.T, -1, 1)
                angles = np.arccos(cosines)
                home = cosines.argmax(1)
                packed = [(v if w else i).tobytes() for v, i, w in zip(x, q.astype("<i4"), wide)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("label"), pa.array([size] * len(x), pa.int32()), pa.array(home, pa.int32()),
                     pa.array(angles[np.arange(len(x)), home]), pa.array(np.linalg.norm(q, axis=1)), pa.array(wide),
                     pa.array([a.tobytes() for a in angles], pa.binary()), pa.array(packed, pa.binary())],
                    ["vec_id", "label", "size", "home", "angle", "norm", "wide", "angles", "q"])

    return map_batches(rows, run, STORED)


# --- blocks and tiles --------------------------------------------------------------------------

# what is packed: numbers as little-endian 64 bits, angles n x references, matrix n x size in 16 or 32
# bits, the vectors of wide rows as doubles one behind the other; bounds of angles and norms over all rows
PACKED = ("part long, size int, n int, ids binary, labels binary, norms binary, wide binary, angles binary, short boolean, "
          "q binary, raw binary, low array<double>, high array<double>, least double, most double, any_wide boolean")


class Pack:
    """Rows of one block or tile."""

    def __init__(self, ids, labels, norms, wide, angles, q, raw):
        self.ids, self.labels, self.norms, self.wide, self.angles, self.q, self.raw = ids, labels, norms, wide, angles, q, raw

    @classmethod
    def of_rows(cls, rows: pa.Table) -> "Pack":
        size, wide = rows["size"][0].as_py(), rows["wide"].to_numpy()
        packed = rows["q"].to_pylist()
        q = np.array([np.zeros(size, "<i4") if w else np.frombuffer(b, "<i4") for b, w in zip(packed, wide)]).reshape(len(packed), size)
        raw = {i: np.frombuffer(packed[i], "<f8") for i in np.flatnonzero(wide).tolist()}
        angles = np.array([np.frombuffer(a, "<f8") for a in rows["angles"].to_pylist()])
        return cls(rows["vec_id"].to_numpy(), rows["label"].to_numpy(), rows["norm"].to_numpy(), wide, angles, q, raw)

    def row(self, part: int) -> dict:
        n, size = self.q.shape
        short = bool(n == 0 or np.abs(self.q).max(initial=0) < 1 << 15)
        raw = b"".join(self.raw[i].tobytes() for i in sorted(self.raw))
        norms = self.norms[~self.wide] if self.wide.any() else self.norms
        return {
            "part": part, "size": size, "n": n, "ids": self.ids.astype("<i8").tobytes(), "labels": self.labels.astype("<i8").tobytes(),
            "norms": self.norms.tobytes(), "wide": self.wide.tobytes(), "angles": self.angles.tobytes(), "short": short,
            "q": self.q.astype("<i2" if short else "<i4").tobytes(), "raw": raw, "low": self.angles.min(0).tolist(),
            "high": self.angles.max(0).tolist(), "least": float(norms.min(initial=0 if not len(norms) else np.inf)),
            "most": float(norms.max(initial=0)), "any_wide": bool(self.wide.any())}

    @classmethod
    def of(cls, row: dict, prefix: str = "") -> "Pack":
        get = lambda name: row[prefix + name]
        n, size = get("n"), get("size")
        numbers = lambda name, kind: np.frombuffer(get(name), kind)
        wide = numbers("wide", bool)
        raw = numbers("raw", "<f8").reshape(-1, size) if wide.any() else np.zeros((0, size))
        return cls(numbers("ids", "<i8"), numbers("labels", "<i8"), numbers("norms", "<f8"), wide, numbers("angles", "<f8").reshape(n, -1),
                   numbers("q", "<i2" if get("short") else "<i4").reshape(n, size), dict(zip(np.flatnonzero(wide).tolist(), raw)))

    def whole(self, i: int) -> list[int]:
        return whole(self.raw[i]) if i in self.raw else self.q[i].tolist()


def bundles(batches, most: int):
    """Consecutive rows of one vector length, at most ``most`` of them, over all batches of a task."""
    held: list[pa.Table] = []
    count = 0

    def taken():
        return pa.concat_tables(held).combine_chunks()

    for batch in batches:
        sizes = batch.column("size").to_numpy()
        edges = np.r_[0, np.flatnonzero(np.diff(sizes)) + 1, len(sizes)]
        for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if held and held[0]["size"][0].as_py() != sizes[start]:
                yield taken()
                held, count = [], 0
            while start < stop:
                step = min(stop - start, most - count)
                held.append(pa.Table.from_batches([batch.slice(start, step)]))
                start, count = start + step, count + step
                if count == most:
                    yield taken()
                    held, count = [], 0
    if held:
        yield taken()


def packed(rows: DataFrame, most: int, extra: str = "", more=None) -> DataFrame:
    """Rows in the order of their directions and angles, packed; ``more(table)`` gives the columns ``extra``.

    A range holds some four packs, whatever the partitions of ``rows``, a written table.
    """
    order = ["size", "home", "angle", "vec_id"]
    ranges = max(1, -(-rows.count() // (4 * most)))
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    schema = PACKED + extra
    arrow = _arrow(schema)

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for rows in bundles(batches, most):
            out = Pack.of_rows(rows).row(number)
            if more:
                out |= more(rows)
            yield pa.RecordBatch.from_pylist([out], schema=arrow)
            number += 1

    return map_batches(dealt, run, schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


# --- bounds ------------------------------------------------------------------------------------------


def angle_bounds(low_a, high_a, low_b, high_b):
    """Least and largest angle between vectors whose angles to the directions lie in these ranges."""
    least = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a)).max(-1)
    most = np.minimum(np.pi, np.minimum(high_a + high_b, 2 * np.pi - low_a - low_b).min(-1))
    return np.maximum(0, least - SLACK), np.minimum(np.pi, most + SLACK)


def score_bounds(low_a, high_a, low_b, high_b, least_b, most_b, norm_a):
    """Bounds of inner products, a little wider than rounding could move them."""
    near, far = angle_bounds(low_a, high_a, low_b, high_b)
    c, d = np.cos(near), np.cos(far)
    high = norm_a * np.where(c >= 0, c * most_b, c * least_b)
    low = norm_a * np.where(d >= 0, d * least_b, d * most_b)
    slack = 1 + 1e-9 * norm_a * most_b
    return low - slack, high + slack


def bound_columns() -> tuple[Column, Column]:
    """The same for a tile ``a`` and a block ``b``, by their ranges."""
    def each(a: str, b: str, f) -> Column:
        return F.zip_with(a, b, f)

    apart = F.zip_with(each("a_low", "high", lambda x, y: x - y), each("low", "a_high", lambda x, y: x - y), lambda x, y: F.greatest(x, y))
    near = F.greatest(F.lit(0.0), F.array_max(apart) - SLACK)
    around = F.zip_with(each("a_high", "high", lambda x, y: x + y), each("a_low", "low", lambda x, y: 2 * np.pi - x - y), lambda x, y: F.least(x, y))
    far = F.least(F.lit(np.pi), F.array_min(around) + SLACK)
    slack = 1 + 1e-9 * F.col("a_most") * F.col("most")
    high = F.when(F.cos(near) >= 0, F.cos(near) * F.col("a_most") * F.col("most")).otherwise(F.cos(near) * F.col("a_least") * F.col("least"))
    low = F.when(F.cos(far) >= 0, F.cos(far) * F.col("a_least") * F.col("least")).otherwise(F.cos(far) * F.col("a_most") * F.col("most"))
    free = F.col("a_any_wide") | F.col("any_wide")
    return F.when(free, float("-inf")).otherwise(low - slack), F.when(free, float("inf")).otherwise(high + slack)


# --- scores --------------------------------------------------------------------------------------------


class Cell:
    """A tile of anchors against a block. ``keys`` order an anchor's candidates: by score, then by smaller id.

    ``floor`` and ``ceiling`` are the least and largest score that each anchor looks for. Outside the
    windows that overlap them keys are minus infinity. A key is score * n + (n - 1 - rank of the id), a
    whole number that doubles hold exactly; where it would not fit, or rows are wide, keys are Python integers.
    """

    def __init__(self, tile: Pack, block: Pack, floor: np.ndarray, ceiling: np.ndarray):
        self.block = block
        n = len(block.ids)
        self.by_id = np.argsort(block.ids, kind="stable")
        rank = np.empty(n, np.int64)
        rank[self.by_id] = np.arange(n)
        self.behind = n - 1 - rank
        most = tile.norms.max(initial=0) * block.norms.max(initial=0)
        self.exact = not tile.wide.any() and not block.wide.any() and most * n < 2.0 ** 52
        if not self.exact:
            self.keys = np.array([[sum(x * y for x, y in zip(a, b)) * n + int(k) for b, k in zip(map(block.whole, range(n)), self.behind)]
                                  for a in map(tile.whole, range(len(tile.ids)))], object).reshape(len(tile.ids), n)
            return
        self.keys = np.full((len(tile.ids), n), -np.inf)
        anchors = tile.q.astype(float)
        for start in range(0, n, WINDOW):
            part = slice(start, start + WINDOW)
            angles, norms = block.angles[part], block.norms[part]
            low, high = score_bounds(tile.angles, tile.angles, angles.min(0), angles.max(0), norms.min(), norms.max(), tile.norms)
            overlap = np.flatnonzero((high >= floor) & (low <= ceiling))
            if len(overlap):
                scores = anchors[overlap] @ block.q[part].T.astype(float)
                self.keys[overlap, part] = scores * n + self.behind[part]

    def hide(self, where: np.ndarray) -> None:
        self.keys[where] = -np.inf if self.exact else -(1 << 5000)

    def known(self, key) -> bool:
        return key > (-np.inf if self.exact else -(1 << 5000))

    def read(self, key) -> tuple[int, int]:
        """Score and id of a key."""
        score, behind = divmod(int(key), len(self.block.ids))
        return score, int(self.block.ids[self.by_id[len(self.block.ids) - 1 - behind]])

    def top(self, i: int, n: int, low=None, high=None) -> list[tuple[int, int]]:
        """The first ``n`` of an anchor's row, which is sorted, with scores from ``low`` to ``high``."""
        row = self.keys[i]
        stop = len(row) if high is None else np.searchsorted(row, (high + 1) * len(row))
        out = []
        for key in row[max(0, stop - n):stop][::-1]:
            if self.known(key):
                score, name = self.read(key)
                if low is None or score >= low:
                    out.append((score, name))
        return out


def clamp(score: int) -> int:
    return min(max(score, LEAST), MOST)


# --- passes ----------------------------------------------------------------------------------------------


def meetings(tiles: DataFrame, blocks: DataFrame) -> DataFrame:
    """Tiles and blocks whose bounds allow a score that an anchor of the tile looks for, with both contents.

    The bounds are compared row by row of the two small tables of ranges, in ``SALT`` parts.
    """
    salt = 64
    ranges = ["part", "size", "low", "high", "least", "most", "any_wide"]
    asked = tiles.select(*[F.col(c).alias("a_" + c) for c in ranges], "floor", "ceiling")
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    have = blocks.select(*ranges).withColumn("b_salt", F.pmod(F.xxhash64("part"), F.lit(salt)).cast("int"))
    low, high = bound_columns()
    pairs = asked.join(have, (F.col("a_size") == F.col("size")) & (F.col("salt") == F.col("b_salt")))
    pairs = cut(pairs.where((high >= F.col("floor")) & (low <= F.col("ceiling"))).select(F.col("a_part").alias("t"), F.col("part").alias("b")), "meetings")
    # a tile's pairs one after the other in a task
    dealt = pairs.repartition(max(1, min(pairs.count(), 10_000))).sortWithinPartitions("t")
    both = dealt.join(blocks, F.col("b") == F.col("part")).drop("part", "low", "high", "least", "most", "any_wide")
    content = ["n", "size", "ids", "labels", "norms", "wide", "angles", "short", "q", "raw"]
    anchors = tiles.select(F.col("part").alias("a_part"), *[F.col(c).alias("a_" + c) for c in content], "sought")
    return both.join(anchors, F.col("t") == F.col("a_part")).drop("a_part", "b")


def own_tops(blocks: DataFrame) -> DataFrame:
    """Anchors with the score of the last positive that their own block gives them, or none."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Pack.of(row)
                chosen = np.flatnonzero(block.ids % ANCHOR_EVERY == 0)
                if not len(chosen):
                    continue
                tile = part_of(block, chosen)
                cell = Cell(tile, block, np.full(len(chosen), -np.inf), np.full(len(chosen), np.inf))
                cell.hide((tile.labels[:, None] != block.labels) | (tile.ids[:, None] == block.ids))
                cell.keys.sort(axis=1)
                seeds = [found[-1][0] if len(found := cell.top(i, POSITIVES)) == POSITIVES else None for i in range(len(chosen))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tile.ids), pa.array(tile.labels), pa.array([tile.q.shape[1]] * len(chosen), pa.int32()),
                     pa.array(tile.angles.argmin(1), pa.int32()), pa.array(tile.angles.min(1)), pa.array(tile.norms), pa.array(tile.wide),
                     pa.array([a.tobytes() for a in tile.angles], pa.binary()),
                     pa.array([tile.raw[i].tobytes() if i in tile.raw else tile.q[i].astype("<i4").tobytes() for i in range(len(chosen))], pa.binary()),
                     pa.array([None if s is None else clamp(s) for s in seeds], pa.int64())],
                    [*[f.split()[0] for f in STORED.split(", ")], "seed"])

    anchors = map_batches(blocks, run, STORED + ", seed long")
    # a repeated id is one anchor: its least row by label and vector
    whole_row = F.struct("label", "size", "q", *[c for c in anchors.columns if c not in ("vec_id", "label", "size", "q")])
    return anchors.groupBy("vec_id").agg(F.min(whole_row).alias("row")).select("vec_id", "row.*")


def part_of(block: Pack, chosen: np.ndarray) -> Pack:
    raw = {i: block.raw[j] for i, j in enumerate(chosen.tolist()) if j in block.raw}
    return Pack(block.ids[chosen], block.labels[chosen], block.norms[chosen], block.wide[chosen], block.angles[chosen], block.q[chosen], raw)


HELD = 200_000  # rows that a task gathers before it keeps the best of them


def best(rows: list[tuple], most: int) -> list[tuple]:
    """Of rows that end in an id and a score the ``most`` best of each group, by score and smaller id."""
    rows.sort(key=lambda r: (*r[:-2], -r[-1], r[-2]))
    out, group, n = [], None, 0
    for row in rows:
        if row[:-2] != group:
            group, n = row[:-2], 0
        n += 1
        if n <= most:
            out.append(row)
    return out


def in_scores(meeting: DataFrame, find, most: int, schema: str) -> DataFrame:
    """``find(tile, block, sought)`` gives the rows of each meeting; a task keeps the ``most`` best of a group
    over the meetings of a tile that it holds."""
    arrow = _arrow(schema)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches):
        held: list[tuple] = []
        tile = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if tile != row["t"] or len(held) > HELD:
                    if held := best(held, most):
                        if tile != row["t"] or len(held) > HELD // 2:
                            yield batch_of(held)
                            held = []
                    tile = row["t"]
                held += find(Pack.of(row, "a_"), Pack.of(row), np.frombuffer(row["sought"], "<i8").reshape(row["a_n"], -1))
        if held := best(held, most):
            yield batch_of(held)

    return map_batches(meeting, run, schema)


def first(df: DataFrame, n: int, *by: str) -> DataFrame:
    """The ``n`` best rows of each group, ranked from 1. Tasks keep their own best before rows move."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "other")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def positives(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """``anchor``, ``other``, ``score``: the first other rows of an anchor's label."""
    def sought(rows: pa.Table) -> dict:
        seeds = rows["seed"].fill_null(LEAST).to_numpy().astype("<i8")
        floor = float("-inf") if (seeds <= LEAST).any() else float(seeds.min())
        return {"sought": seeds.tobytes(), "floor": floor, "ceiling": float("inf")}

    def find(tile: Pack, block: Pack, seeds: np.ndarray):
        floor = np.where(seeds[:, 0] <= LEAST, -np.inf, seeds[:, 0].astype(float))
        cell = Cell(tile, block, floor, np.full(len(floor), np.inf))
        cell.hide((tile.labels[:, None] != block.labels) | (tile.ids[:, None] == block.ids))
        if cell.exact and len(block.ids) > POSITIVES:
            cell.keys = np.partition(cell.keys, -POSITIVES, axis=1)[:, -POSITIVES:]
            rows = np.sort(cell.keys, axis=1)
        else:
            rows = np.sort(cell.keys, axis=1)
        out = []
        for i, row in enumerate(rows):
            for key in row[-POSITIVES:]:
                if cell.known(key):
                    score, other = cell.read(key)
                    if score >= floor[i]:
                        out.append((int(tile.ids[i]), other, clamp(score)))
        return out

    tiles = cut(packed(anchors, TILE, ", sought binary, floor double, ceiling double", sought), "anchor-tiles")
    found = in_scores(meetings(tiles, blocks), find, POSITIVES, "anchor long, other long, score long")
    return first(found, POSITIVES, "anchor").select("anchor", "other", "score", "rank")


def score_window(positive: int) -> tuple[int, int]:
    """Least and largest score of a negative of a positive with this score."""
    return -(-LOW * positive // 100), HIGH * positive // 100


def negatives(blocks: DataFrame, anchors: DataFrame, found: DataFrame) -> DataFrame:
    """``anchor``, ``nth`` (its positive), ``other``, ``score``, ``rank``."""
    none = LEAST  # in place of a score where there are fewer positives
    scores = found.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("rank", "score"))).alias("scores"))
    rows = anchors.drop("seed").join(scores, F.col("vec_id") == F.col("anchor")).withColumn(
        "scores", F.transform(F.sequence(F.lit(1), F.lit(POSITIVES)), lambda i: F.coalesce(F.col("scores")[i], F.lit(none)))).drop("anchor")
    rows = cut(rows, "anchors-with-positives")

    def limits(scores: np.ndarray) -> list[list[tuple[int, int] | None]]:
        out = []
        for row in scores.tolist():
            windows = [None if s <= none else score_window(s) for s in row]
            out.append([w if w and w[0] <= w[1] else None for w in windows])
        return out

    def ranges(windows) -> tuple[np.ndarray, np.ndarray]:
        low = [min((w[0] for w in row if w), default=np.inf) for row in windows]
        high = [max((w[1] for w in row if w), default=-np.inf) for row in windows]
        return np.array(low, float), np.array(high, float)

    def sought(rows: pa.Table) -> dict:
        scores = np.array(rows["scores"].to_pylist(), "<i8").reshape(rows.num_rows, POSITIVES)
        low, high = ranges(limits(scores))
        return {"sought": scores.tobytes(), "floor": float(low.min()), "ceiling": float(high.max())}

    def find(tile: Pack, block: Pack, scores: np.ndarray):
        windows = limits(scores)
        low, high = ranges(windows)
        cell = Cell(tile, block, low, high)
        cell.hide(tile.labels[:, None] == block.labels)
        cell.keys.sort(axis=1)
        out = []
        for i, row in enumerate(windows):
            name = int(tile.ids[i])
            for nth, window in enumerate(row, 1):
                if window:
                    out += [(name, nth, other, clamp(score)) for score, other in cell.top(i, NEGATIVES, *window)]
        return out

    tiles = cut(packed(rows, TILE, ", sought binary, floor double, ceiling double", sought), "anchor-tiles")
    near = in_scores(meetings(tiles, blocks), find, NEGATIVES, "anchor long, nth int, other long, score long")
    return first(near, NEGATIVES, "anchor", "nth")


def hard_negatives(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Rows with a null key, label or vector or a component that is null or not finite take no
    part. Vectors meet those of their own length. Equal scores are ranked by smaller key. Of rows
    that share an anchor's key one is the anchor and none is its positive; other rows of one key
    each count. Scores are exact for every finite vector; those beyond 64 bits are ranked within
    a block by their true value and given as the nearest number of 64 bits. Empty vectors score 0.
    An empty table gives an empty table; further columns are not looked at, so none can clash.
    """
    ship(df.sparkSession)
    rows = participants(df, key, vector, label)
    measured = cut(stored(rows, references(rows)), "measured-vectors")
    blocks = cut(packed(measured, BLOCK), "vector-blocks")
    anchors = cut(own_tops(blocks), "anchors")
    found = cut(positives(blocks, anchors), "positives")
    near = negatives(blocks, anchors, found)
    own = found.select(F.col("anchor").alias("p_anchor"), F.col("rank").alias("p_rank"), F.col("other").alias("positive_id"),
                       F.col("score").alias("positive_score"))
    out = near.join(own, (F.col("anchor") == F.col("p_anchor")) & (F.col("nth") == F.col("p_rank")))
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"),
                      F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


OP13_SQL = """
WITH took AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same,
         CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM took a JOIN took b ON len(a.q) = len(b.q) AND a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0
), positive AS (
  SELECT anchor, other, score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5
), negative AS (
  SELECT p.anchor, p.other AS positive_id, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other) AS rank
  FROM positive p JOIN scored n ON p.anchor = n.anchor AND NOT n.same
   AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor AS anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negative WHERE rank <= 3
"""


@query("op13_hard_negatives", OP13_SQL)
def op13_hard_negatives(spark, sf_dir):
    """Hard negatives of every fiftieth vector among all."""
    return hard_negatives(table(spark, sf_dir, "embeddings"))
