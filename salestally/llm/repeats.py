"""Removal of byte strings that occur twice or more, in the manner of a suffix array.

All suffixes of a large corpus cannot be sorted in the memory there is, so they
are sorted bucket by bucket, and a sample of positions settles long ties. The
sample is chosen by content, not by position modulo a period: of every 200
bytes the least hash of a 32-byte string marks the sample position. So equal
strings hold their sample at the same place, and the bucket of a string is the
32 bytes at its sample. Strings whose bucket holds nothing else are unique and
go no further; strings in wholly equal surroundings are settled by counting; only
the rest is sorted, one bucket at a time, by names of pieces that double in
length up to the whole string, and equal names are compared byte by byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salestally.llm.common import arrow_schema, documents, map_batches, query
from salestally.llm.lm import mix64
from salestally.session import cut

LENGTH = 200
SAMPLE = 32  # bytes hashed at a sample position
REACH = LENGTH - SAMPLE + 1  # sample positions to choose from in a string
BUCKET = 50_000  # surroundings that one task sorts together; larger buckets are dealt out by string
STEP = np.uint64(0x9E3779B97F4A7C15)


def _doubled(values: np.ndarray, n: int, join) -> np.ndarray:
    """``join`` over every ``n`` consecutive values along the last axis, by doubling."""
    out, have = values, 1
    while have < n:
        step = min(have, n - have)
        out = join(out[..., :out.shape[-1] - step], out[..., step:], step)
        have += step
    return out


def sample_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes at every position."""
    powers = {1 << k: np.uint64(pow(int(STEP), 1 << k, 1 << 64)) for k in range(8)}
    start = mix64(raw.astype(np.uint64) + np.uint64(1))
    return mix64(_doubled(start, SAMPLE, lambda a, b, step: a * powers[step] + b))


CHUNK = 1 << 16  # bytes of texts that are gone through together


def surroundings(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of strings with one sample position: text, hash at the sample, first and last start, sample position.

    Texts are gone through together, one behind the other; a string's sample lies inside it, so
    what is found for the strings inside a text is not touched by its neighbours.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join(texts), np.uint8)
    n = len(raw) - LENGTH + 1
    last = starts + sizes - LENGTH  # of each text the last start of a string; before its start if there is none
    if n <= 0 or (last < starts).all():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    hashes = sample_hashes(raw)
    least = _doubled(hashes, REACH, lambda a, b, _: np.minimum(a, b))
    edge = np.zeros(n + 1, np.int64)
    some = last >= starts
    edge[starts[some]] += 1
    edge[last[some] + 1] -= 1
    inside = np.cumsum(edge[:-1]) > 0
    padded = np.r_[np.zeros(REACH - 1, np.uint64), np.where(inside, least, np.uint64(0)), np.zeros(REACH - 1, np.uint64)]
    chosen = np.flatnonzero(_doubled(padded, REACH, lambda a, b, _: np.maximum(a, b)) == hashes)
    breaks = np.zeros(n + 1, bool)
    breaks[starts[some]] = True
    breaks[1:-1] |= least[1:] != least[:-1]
    breaks[np.minimum(chosen + 1, n)] = True
    breaks = np.flatnonzero(breaks[:-1] & inside)
    # the first chosen position from the break on that has the least hash
    values, group = np.unique(hashes[chosen], return_inverse=True)
    width = np.int64(len(raw) + 1)
    keys = np.sort(group * width + chosen)
    at = keys[np.searchsorted(keys, np.searchsorted(values, least[breaks]) * width + breaks)] % width
    first = np.r_[True, at[1:] != at[:-1]]
    begin, at = breaks[first], at[first]
    text = np.searchsorted(starts, begin, "right") - 1
    end = np.minimum(np.r_[begin[1:], n] - 1, last[text])
    base = starts[text]
    return text, hashes[at], begin - base, end - base, at - base


def surroundings_of(column) -> tuple[list[bytes], tuple[np.ndarray, ...]]:
    """The texts of a column, and ``surroundings`` of all, some texts at a time."""
    texts = [value.as_py() for value in column]
    found, held, size = [], [], 0
    for i, text in enumerate(texts):
        if len(text) >= LENGTH:
            held.append((i, text))
            size += len(text)
        if held and (size >= CHUNK or i == len(texts) - 1):
            text_of, *rest = surroundings([t for _, t in held])
            found.append((np.array([j for j, _ in held], np.int64)[text_of], *rest))
            held, size = [], 0
    if not found:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)]
    return texts, tuple(map(np.concatenate, zip(*found)))


def contexts(texts: list[bytes], text: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each run and of the place of the sample in it."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(texts[t][b:e], a) for t, b, e, a in zip(
        text.tolist(), begin.tolist(), (end + LENGTH).tolist(), (at - begin).tolist())), np.uint64, len(begin)).view(np.int64)


def repeated(pieces: list[bytes], place: np.ndarray, bucket: np.ndarray) -> list[np.ndarray]:
    """For each piece of text the starts (from its sample position backwards) of strings that another
    piece of the same bucket has too. ``place``: the sample's place in the piece."""
    wide = max(map(len, pieces))
    raw = np.zeros((len(pieces), wide + LENGTH), np.uint8)
    for i, piece in enumerate(pieces):
        raw[i, :len(piece)] = np.frombuffer(piece, np.uint8)
    n = np.array([len(p) - LENGTH + 1 for p in pieces])
    rows, starts = np.repeat(np.arange(len(pieces)), n), np.concatenate([np.arange(k) for k in n])
    name = np.empty(len(rows), np.uint64)
    for lo in range(0, len(pieces), 512):  # names of whole strings, some pieces at a time
        part = mix64(raw[lo:lo + 512].astype(np.uint64) + np.uint64(1))
        part = _doubled(part, LENGTH, lambda a, b, step: mix64(a * STEP + b + np.uint64(step)))
        here = slice(*np.searchsorted(rows, [lo, lo + 512]))
        name[here] = part[rows[here] - lo, starts[here]]
    offset = place[rows] - starts
    order = np.lexsort((name, offset, bucket[rows]))
    same = np.flatnonzero((bucket[rows[order[1:]]] == bucket[rows[order[:-1]]]) & (offset[order[1:]] == offset[order[:-1]])
                          & (name[order[1:]] == name[order[:-1]]))
    found = np.zeros(len(rows), bool)
    span = np.arange(LENGTH)
    for part in np.array_split(same, len(same) // 20_000 + 1):
        a, b = order[part], order[part + 1]
        equal = (raw[rows[a][:, None], starts[a][:, None] + span] == raw[rows[b][:, None], starts[b][:, None] + span]).all(1)
        found[a[equal]] = found[b[equal]] = True
    bounds = np.cumsum(n)[:-1]
    return [offset_[hit] for offset_, hit in zip(np.split(offset, bounds), np.split(found, bounds))]


def covered(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Maximal runs of bytes covered by strings that begin at ``starts`` to ``ends``, both included: start and end of each."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order]) + LENGTH
    first = np.r_[True, starts[1:] > ends[:-1]]
    return np.column_stack([starts[first], np.r_[ends[:-1][first[1:]], ends[-1:]]])


def _each(rows: DataFrame, make, schema) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = make(batch)
            if len(out[0]):
                yield pa.RecordBatch.from_arrays(out, [f.name for f in arrow])

    arrow = arrow_schema(schema) if not isinstance(schema, str) else _arrow(rows, schema)
    return map_batches(rows, run, schema)


def _arrow(rows: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.types import StructType

    return arrow_schema(StructType.fromDDL(schema))


def _counts(rows: DataFrame) -> DataFrame:
    """``bucket`` and the number of runs that have it in each batch."""
    def make(batch):
        _, (_, buckets, *_) = surroundings_of(batch.column("body"))
        values, n = np.unique(buckets.view(np.int64), return_counts=True)
        return [pa.array(values), pa.array(n)]

    return _each(rows, make, "bucket long, n long")


def _runs(rows: DataFrame) -> DataFrame:
    """A row for each run of each text, with the text's ``key`` and ``hash``."""
    def make(batch):
        texts, (text, buckets, begin, end, at) = surroundings_of(batch.column("body"))
        who = pa.array(text)
        return [batch.column("key").take(who), batch.column("hash").take(who), pa.array(buckets.view(np.int64)),
                pa.array(contexts(texts, text, begin, end, at)), pa.array(begin.astype(np.int32)),
                pa.array((end - begin).astype(np.int32)), pa.array((at - begin).astype(np.int32))]

    return _each(rows, make, "key long, hash long, bucket long, context long, begins int, runs int, into int")


def _pieces(rows: DataFrame) -> DataFrame:
    def make(batch):
        out: list[list] = [[], [], [], []]
        for value, runs in zip(batch.column("body"), batch.column("runs").to_pylist()):
            raw = value.as_py()
            for r in runs:
                if r["sort"]:
                    out[0].append(r["bucket"])
                    out[1].append(r["context"])
                    out[2].append(r["into"])
                    out[3].append(raw[r["begins"]:r["begins"] + r["runs"] + LENGTH])
        return [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())]

    return _each(rows, make, "bucket long, context long, into int, piece binary")


def _sort(rows: pa.Table) -> pa.Table:
    place = rows["into"].to_numpy()
    found = repeated([x.as_py() for x in rows["piece"]], place, rows["bucket"].to_numpy()) if rows.num_rows else []
    hit = [i for i, f in enumerate(found) if len(f)]
    return pa.table({"f_bucket": rows["bucket"].take(pa.array(hit, pa.int64())), "f_context": rows["context"].take(pa.array(hit, pa.int64())),
                     "offsets": pa.array([np.sort(found[i]).astype(np.int32) for i in hit], pa.list_(pa.int32()))})


def _large(pieces: DataFrame) -> DataFrame:
    """The same as ``_sort`` for buckets of any size: a row for each string, counted by its hashes."""
    def make(batch):
        out: list[list] = [[], [], [], [], []]
        for b, c, into, piece in zip(*(batch.column(k).to_pylist() for k in ("bucket", "context", "into", "piece"))):
            for start in range(len(piece) - LENGTH + 1):
                digest = np.frombuffer(xxhash.xxh3_128_digest(piece[start:start + LENGTH]), np.int64)
                for k, v in enumerate((b, c, into - start, *digest.tolist())):
                    out[k].append(v)
        return [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()),
                *(pa.array(x, pa.int64()) for x in out[3:])]

    each = _each(pieces, make, "bucket long, context long, offset int, h1 long, h2 long")
    key = ["bucket", "offset", "h1", "h2"]
    twice = each.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*[F.col(k).alias("t_" + k) for k in key])
    hit = each.join(cut(twice, "repeats-twice"), [F.col(k) == F.col("t_" + k) for k in key])
    return hit.groupBy(F.col("bucket").alias("f_bucket"), F.col("context").alias("f_context")).agg(
        F.sort_array(F.collect_set("offset")).alias("offsets"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_bytes``, ``spans`` (start and end of each removed run, in
    bytes) and ``left`` (the remaining bytes).

    Null and empty texts have no bytes, texts of fewer than 200 bytes lose none. Rows that repeat
    one another lose all that is long enough, each. An empty table gives an empty table.
    """
    body = F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary")
    rows = docs.select(docs[key].cast("long").alias("key"), F.xxhash64(body).alias("hash"), body.alias("body"))
    per = _counts(rows).groupBy("bucket").agg(F.sum("n").alias("total")).where("total > 1").select(F.col("bucket").alias("k_bucket"))
    # runs in buckets of one run are unique and go no further
    shared = cut(_runs(rows).join(per, F.col("bucket") == F.col("k_bucket")).drop("k_bucket"), "repeats-runs")
    # how many surroundings a bucket has
    per = cut(shared.groupBy("bucket", "context").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("bucket").alias("k_bucket")).agg(
        F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total")).where("kinds > 1"), "repeats-buckets")
    flagged = shared.join(per, F.col("bucket") == F.col("k_bucket"), "left").withColumn("kinds", F.coalesce("kinds", F.lit(1)))
    flagged = flagged.groupBy(F.coalesce("key", F.lit(0)).alias("r_key"), F.col("key").isNull().alias("r_null"), F.col("hash").alias("r_hash")).agg(
        F.collect_set(F.struct("bucket", "context", "begins", "runs", "into", (F.col("kinds") > 1).alias("sort"),
                               (F.col("kinds") > bucket).alias("large"))).alias("runs"))
    joined = rows.join(flagged, (F.coalesce("key", F.lit(0)) == F.col("r_key")) & (F.col("key").isNull() == F.col("r_null"))
                       & (F.col("hash") == F.col("r_hash")), "left").select("key", "body", F.coalesce("runs", F.array()).alias("runs"))
    joined = cut(joined.withColumn("row", F.monotonically_increasing_id()), "repeats-texts")
    some = joined.where(F.exists("runs", lambda r: r["sort"]))
    pieces = _pieces(some.select("body", "runs")).groupBy("bucket", "context").agg(
        F.first("into").alias("into"), F.first("piece").alias("piece"), F.count(F.lit(1)).alias("n"))
    pieces = cut(pieces, "repeats-pieces")
    n_pieces = pieces.count()
    size = per.select(F.col("k_bucket").alias("z_bucket"), "kinds")
    dealt = pieces.join(size, F.col("bucket") == F.col("z_bucket")).drop("z_bucket")
    groups = max(1, n_pieces // 5000)
    found = dealt.where(F.col("kinds") <= bucket).withColumn("part", F.pmod(F.xxhash64("bucket"), F.lit(groups))).groupBy(
        "part").applyInArrow(_sort, "f_bucket long, f_context long, offsets array<int>")
    if not per.where(F.col("kinds") > bucket).isEmpty():
        found = found.union(_large(dealt.where(F.col("kinds") > bucket).select("bucket", "context", "into", "piece")))
    found = cut(found, "repeats-found")
    # surroundings seen twice are repeated as a whole; the gathered runs hold every run of their buckets
    each = joined.select("row", F.explode("runs").alias("r")).select("row", "r.*")
    twice = each.groupBy(F.col("bucket").alias("f_bucket"), F.col("context").alias("f_context")).agg(
        F.count(F.lit(1)).alias("n")).where("n > 1").select("f_bucket", "f_context", F.lit(None).cast("array<int>").alias("offsets"))
    verdict = cut(found.union(twice).groupBy("f_bucket", "f_context").agg(
        F.max(F.col("offsets").isNull()).alias("whole"), F.max("offsets").alias("offsets")), "repeats-verdicts")
    each = each.join(verdict, (F.col("bucket") == F.col("f_bucket")) & (F.col("context") == F.col("f_context")))
    gathered = each.groupBy(F.col("row").alias("g_row")).agg(
        F.collect_list(F.struct("begins", "runs", "into", "whole", "offsets")).alias("hits"))
    out = joined.drop("runs").join(gathered, F.col("row") == F.col("g_row"), "left").select("key", "body", "hits")
    final = "key long, n_bytes long, spans array<struct<starts:int,ends:int>>, left binary"

    def apply(batch):
        sizes, spans, kept = [], [], []
        for value, hits in zip(batch.column("body"), batch.column("hits").to_pylist()):
            raw = value.as_py()
            if not hits:
                sizes.append(len(raw))
                spans.append([])
                kept.append(raw)
                continue
            starts, ends = [], []
            for h in hits:
                if h["whole"]:
                    starts.append(h["begins"])
                    ends.append(h["begins"] + h["runs"])
                else:
                    at = (h["begins"] + h["into"] - np.array(h["offsets"])).tolist()
                    starts += at
                    ends += at
            runs = covered(np.array(starts, np.int64), np.array(ends, np.int64)).tolist()
            sizes.append(len(raw))
            spans.append([{"starts": a, "ends": b} for a, b in runs])
            kept.append(b"".join(raw[a:b] for (_, a), (b, _) in zip([(0, 0), *runs], [*runs, (len(raw), 0)])))
        return [batch.column("key"), pa.array(sizes, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("starts", pa.int32()), ("ends", pa.int32())]))), pa.array(kept, pa.binary())]

    return _each(out, apply, final).withColumnRenamed("key", key)


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark, sf_dir):
    """Every document without the strings of 200 bytes that stand elsewhere too, as counts and digest."""
    out = without_repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["ends"] - s["starts"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("left", 256).alias("kept_sha256"))
