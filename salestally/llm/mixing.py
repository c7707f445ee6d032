"""Mixing sources to target weights.

Sampling by exponential keys (Efraimidis and Spirakis): a document's key is
``-ln(u) / weight``, its source's documents are taken in the order of their
keys until the words taken reach the source's budget. Whole epochs come first;
what is left of the target is a fraction of one epoch.

The prefix sums take two steps, so that no task sorts a whole source: sums per
bucket of keys say in which bucket the budget runs out, and only that bucket
is sorted. What follows is one cut per source, and taking is a filter on it.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salestally.llm.common import WORD, documents, query, text_or_empty
from salestally.session import cut

# sources that one mix can have; their sizes and targets are a list on the driver
MAX_SOURCES = 10_000
# ranges of keys within a source; the one where its budget ends is sorted
BUCKETS = 1 << 16
SEED = 17


def n_words(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0 and 1: the more markup symbols to a word, the lower."""
    symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>]"))
    return (size + 1).cast("double") / (size + 1 + 10 * symbols).cast("double")


def uniform(parts: list[Column]) -> Column:
    """A number between 0 and 1, neither included, from the parts' MD5."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


@dataclass(frozen=True)
class Target:
    source: str | None
    source_size: int
    target: float


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], share: float = 1.5,
            most: float = 2.0) -> list[Target]:
    """Words to take from each source: ``share`` of all words dealt out by weight; a source
    gives at most ``most`` times its words, and what is over goes to the others by weight."""
    total, capped, open_ = share * sum(sizes.values()), {}, dict(weights)
    while True:
        left, weight = total - sum(capped.values()), sum(open_.values())
        over = [s for s, w in open_.items() if left * w / weight > most * sizes[s]]
        if not over:
            break
        for s in over:
            capped[s] = most * sizes[s]
            del open_[s]
    return [Target(s, sizes[s], float(capped[s]) if s in capped else left * weights[s] / weight) for s in weights]


def weights_in_order(sources: list[str | None], cycle=(5, 2, 1)) -> dict[str | None, float]:
    """Sources by code point, null last, with the weights of the cycle."""
    ordered = sorted(s for s in sources if s is not None) + [None] * (None in sources)
    return {s: cycle[i % len(cycle)] for i, s in enumerate(ordered)}


class Mix:
    """How much of each document a mix takes.

    ``size`` and ``weight`` (a document's quality weight, above 0) are columns made from a row;
    ``weights`` gives the sources' weights from the list of sources found.

    Null texts have the size 0; a null source is a source; a document of size 0 is never taken.
    Rows that repeat one another in ``doc_id`` and text have one key, so they are taken
    together. An empty table gives an empty mix. More than ``MAX_SOURCES`` sources are an error.
    """

    def __init__(self, docs: DataFrame, weights=weights_in_order, share: float = 1.5, most: float = 2.0,
                 seed: int = SEED, buckets: int = BUCKETS):
        self.seed, self.buckets, self.spark = seed, buckets, docs.sparkSession
        self.keyed = cut(self.with_keys(docs.select("doc_id", "text", "source")).drop("text"), "mix-keys")
        summed = cut(self.keyed.groupBy("source", "mix_bucket").agg(F.sum("mix_size").alias("words")), "mix-sums")
        per = (summed.groupBy("source").agg(F.sum("words").alias("words"))
               .limit(MAX_SOURCES + 1).toArrow().to_pylist())
        if len(per) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        sizes = {r["source"]: r["words"] for r in per}
        found = targets(sizes, weights(list(sizes)), share, most) if sizes else []
        rows = []
        for t in found:
            epochs = int(t.target // t.source_size) if t.source_size else 0
            rows.append((t.source, t.source_size, t.target, epochs, t.target - epochs * t.source_size))
        self.plan = self.spark.createDataFrame(pa.table(
            [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, PLAN.types)], schema=PLAN))
        self.cuts = cut(self._cuts(summed), "mix-cuts")

    def with_keys(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``mix_size``, ``mix_key`` and ``mix_bucket``."""
        text = text_or_empty(docs)
        out = docs.withColumn("mix_size", n_words(text))
        u = uniform([F.lit(str(self.seed)), F.coalesce(docs["doc_id"].cast("string"), F.lit("-")), text])
        out = out.withColumn("mix_key", -F.ln(u) / quality_weight(text, F.col("mix_size")))
        return out.withColumn(
            "mix_bucket", F.least(F.floor(self.buckets * (1 - F.exp(-F.col("mix_key")))), F.lit(self.buckets - 1)))

    def _cuts(self, summed: DataFrame) -> DataFrame:
        """Per source of the plan: take buckets below ``cut_bucket``, and in it keys up to ``cut_key``."""
        plan, before = self.plan, Window.partitionBy("source").orderBy("mix_bucket")
        sums = summed.withColumn("upto", F.sum("words").over(before.rowsBetween(Window.unboundedPreceding, 0)))
        p = plan.select(F.col("source").alias("p_source"), "rest")
        edge = (sums.join(p, sums["source"].eqNullSafe(p["p_source"]))
                .where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
                .select("p_source", F.col("mix_bucket").alias("cut_bucket"), "rest",
                        (F.col("upto") - F.col("words")).alias("before")))
        edge = cut(edge, "mix-edges")
        inside = self.keyed.join(
            edge, self.keyed["source"].eqNullSafe(edge["p_source"]) & (self.keyed["mix_bucket"] == edge["cut_bucket"]))
        ties = inside.groupBy("p_source", "cut_bucket", "rest", "before", "mix_key").agg(F.sum("mix_size").alias("words"))
        run = Window.partitionBy("p_source").orderBy("mix_key").rowsBetween(Window.unboundedPreceding, 0)
        ties = ties.withColumn("upto", F.col("before") + F.sum("words").over(run))
        taken = F.col("upto") - F.col("words") / 2 <= F.col("rest")  # as near to the budget as can be
        last = ties.groupBy("p_source", "cut_bucket").agg(F.max(F.when(taken, F.col("mix_key"))).alias("cut_key"))
        plan = plan.withColumnRenamed("source", "plan_source")
        return plan.join(last, plan["plan_source"].eqNullSafe(last["p_source"]), "left").drop("p_source", "rest")

    def taken(self, keyed: DataFrame) -> DataFrame:
        """``keyed`` with ``mix_copies``, how often each row is taken, and what holds for its source."""
        chosen = (F.col("mix_bucket") < F.col("cut_bucket")) | (
            (F.col("mix_bucket") == F.col("cut_bucket")) & (F.col("mix_key") <= F.col("cut_key")))
        out = keyed.join(self.cuts, keyed["source"].eqNullSafe(self.cuts["plan_source"]), "left").drop("plan_source")
        copies = F.coalesce(F.col("epochs"), F.lit(0)) + F.when(F.coalesce(chosen, F.lit(False)), 1).otherwise(0)
        return out.withColumn("mix_copies", F.when(F.col("mix_size") > 0, copies).otherwise(0))

    def documents(self, docs: DataFrame) -> DataFrame:
        """The mix itself: each row of ``docs`` as often as it is taken."""
        names = ["doc_id", "text", "source"]
        own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *[docs[c] for c in names])
        out = self.taken(self.with_keys(own))
        out = out.where("mix_copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("mix_copies"))))
        return out.select("row.*")


PLAN = pa.schema([("source", pa.string()), ("source_size", pa.int64()), ("target", pa.float64()),
                  ("epochs", pa.int32()), ("rest", pa.float64())])

OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
keyed AS (
  SELECT doc_id, source, size,
         -ln((CAST(('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || t), 1, 13)) AS BIGINT)
              + 0.5) / 4503599627370496.0)
         / (CAST(size + 1 AS DOUBLE)
            / CAST(size + 1 + 10 * (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g'))) AS DOUBLE)) AS k
  FROM sized),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w
  FROM keyed GROUP BY source),
-- a source is capped if its share is above its cap once those with lower caps to their weight are
ordered AS (
  SELECT *, sum(2.0 * source_size) OVER (o ROWS UNBOUNDED PRECEDING) - 2.0 * source_size AS capped_before,
         sum(w) OVER () - sum(w) OVER (o ROWS UNBOUNDED PRECEDING) + w AS w_open,
         1.5 * sum(source_size) OVER () AS total
  FROM sources WINDOW o AS (ORDER BY 2.0 * source_size / w, source NULLS LAST)),
tested AS (
  SELECT *, (total - capped_before) * w / w_open > 2.0 * source_size AS over_cap FROM ordered),
rest_of AS (
  SELECT (SELECT max(total) FROM tested) - coalesce(sum(2.0 * source_size) FILTER (over_cap), 0) AS left_over,
         sum(w) FILTER (NOT over_cap) AS weight
  FROM tested),
plan AS (
  SELECT source, source_size,
         CASE WHEN over_cap THEN 2.0 * source_size ELSE CAST(left_over AS DOUBLE) * w / weight END AS target
  FROM tested, rest_of),
ran AS (
  SELECT k.*, p.source_size, CAST(p.target AS DOUBLE) AS target,
         CASE WHEN p.source_size > 0 THEN floor(p.target / p.source_size) ELSE 0 END AS epochs,
         sum(size) OVER (PARTITION BY k.source ORDER BY k.k RANGE UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER (PARTITION BY k.source, k.k) AS tie
  FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN target - epochs * source_size > 0
                                   AND upto - tie / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ran
"""


@query("op2_mixing", OP2_SQL)
def op2_mixing(spark, sf_dir):
    """All documents mixed to 5 : 2 : 1, how many words each gives."""
    mix = Mix(documents(spark, sf_dir))
    return mix.taken(mix.keyed).select(
        "doc_id", F.col("mix_size").alias("size"), "source_size", "target",
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"))
