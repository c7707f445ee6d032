"""Quality rules: a document's own counts, and lines that many documents of a host share.

Lines are normalised and hashed, and per host the documents that have a line
are counted. A line above the limit is removed as boilerplate, and a document
of which little is left is rejected.

Copies of one text must not make each other's lines look like boilerplate. So lines
that enough documents have are candidates first, and documents are told apart by what they
have besides them: a line is above the limit if enough documents have it that differ in
their other lines. Copies, which have no other lines or the same ones, count as one.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salestally.llm.common import WORD, documents, query, text_or_empty
from salestally.session import cut

MIN_WORDS = 50
MAX_REPEATED = 50  # percent of words in repeated three-word windows
LINE_DOCUMENTS = 10  # a line that more documents of a host have is removed
LEAST_LEFT = 0.2  # of the characters in lines; with less a document is depleted
WINDOW = 3
BLANK = r"[\x20\x09\x0B-\x0D]+"  # within a line


def window(words: str, i: Column) -> list[Column]:
    return [F.get(words, i + k) for k in range(WINDOW)]


def with_repeated_words(df: DataFrame, hashes: str) -> DataFrame:
    """``df`` with ``n_repeat_words``: words in windows whose hash occurs twice or more, the
    first occurrence included.

    Windows are sorted by hash; those with an equal neighbour are repeated. In the order of
    their places each covers three words, or fewer if the next one starts before its end.
    Each step is a column of its own, so that it is computed once.
    """
    size = F.size(hashes)
    nowhere = F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(None).cast("int").alias("i")))
    df = df.withColumn("q_sorted", F.when(F.size(F.array_distinct(hashes)) < size, F.sort_array(
        F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.slice(nowhere, 1, 0)))
    three = F.arrays_zip(F.col("q_sorted").alias("x"), F.slice("q_sorted", 2, size).alias("y"),
                         F.concat(nowhere, F.col("q_sorted")).alias("z"))
    same = F.filter(three, lambda t: (t["x"]["h"] == t["y"]["h"]) | (t["x"]["h"] == t["z"]["h"]))
    df = df.withColumn("q_places", F.sort_array(F.transform(same, lambda t: t["x"]["i"])))
    gaps = F.transform(
        F.arrays_zip(F.col("q_places").alias("a"), F.slice("q_places", 2, size).alias("b")),
        lambda t: F.coalesce(F.least(F.lit(WINDOW), t["b"] - t["a"]), F.lit(0)))
    return df.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0), lambda total, x: total + x).cast("long")
                         ).drop("q_sorted", "q_places")


def profile(df: DataFrame, text: Column, host: Column) -> DataFrame:
    """``df`` with counts and hashed lines, in the columns ``q_*``."""
    out = df.withColumn("q_text", text).withColumn("q_host", F.coalesce(F.concat(F.lit("="), host), F.lit("")))
    out = out.withColumn("q_words", F.regexp_extract_all("q_text", F.lit(WORD), F.lit(0)))
    out = out.withColumn("q_hashes", F.slice(
        F.transform("q_words", lambda w, i: F.xxhash64(*window("q_words", i))), 1, F.greatest(F.size("q_words") - WINDOW + 1, F.lit(0))))
    out = with_repeated_words(out, "q_hashes")
    lines = F.filter(F.split("q_text", "\n"), lambda line: line.rlike(WORD))
    normal = F.split(F.lower(F.regexp_replace("q_text", BLANK, " ")), "\n")
    out = out.select(
        *[c for c in out.columns if c not in ("q_words", "q_hashes", "q_text", "n_repeat_words")],
        F.size("q_words").cast("long").alias("n_words"),
        F.length(F.array_join("q_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("q_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.filter(F.transform(normal, lambda line: F.struct(
            F.xxhash64(F.trim(line)).alias("h"), F.length(F.trim(line)).alias("n"))), lambda x: x["n"] > 0).alias("q_lines"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))


def boilerplate(profiles: DataFrame, limit: int = LINE_DOCUMENTS) -> DataFrame:
    """Host and hash of the lines above the limit. A document counts once for a line."""
    each = profiles.select("q_id", "q_host", F.explode(F.array_distinct(F.transform("q_lines", lambda x: x["h"]))).alias("h"))
    many = each.groupBy("q_host", "h").agg(F.count(F.lit(1)).alias("documents")).where(F.col("documents") > limit)
    many = cut(many.select(F.col("q_host").alias("m_host"), F.col("h").alias("m_h")), "rules-candidates")
    marked = each.join(many, (F.col("q_host") == F.col("m_host")) & (F.col("h") == F.col("m_h")), "left")
    # per document: its candidates, and one number for the set of its other lines
    own = marked.groupBy("q_id", "q_host").agg(
        F.collect_list("m_h").alias("lines"),
        F.coalesce(F.bit_xor(F.when(F.col("m_h").isNull(), F.xxhash64("h", F.lit(1)))), F.lit(0)).alias("others"))
    by_text = own.where(F.size("lines") > 0).select("q_host", "others", F.explode("lines").alias("h")).distinct()
    by_line = by_text.groupBy("q_host", "h").agg(F.count(F.lit(1)).alias("texts"))
    return by_line.where(F.col("texts") > limit).select(F.col("q_host").alias("b_host"), F.col("h").alias("b_h"))


def without_lines(text: Column, hashes: Column) -> Column:
    """The text without the lines whose normalised form has one of these hashes."""
    hashed = lambda line: F.xxhash64(F.trim(F.lower(F.regexp_replace(line, BLANK, " "))))
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.array_contains(hashes, hashed(line))), "\n")


def judge(docs: DataFrame, text: str = "text", host: str = "source", carry: list[str] | None = None,
          clean: bool = False) -> DataFrame:
    """Every row of ``docs`` (``carry``: the columns wanted, all unless given) as struct ``row``,
    with its counts, ``base_failed``, ``kept`` and ``n_removed_lines``; with ``clean`` also ``left``,
    the text without the lines above the limit.

    A null text counts as empty; both have no words and fail. Null hosts make up one host.
    Repeated rows are judged each, and count as one text for their lines. A very long text is
    one row throughout. Equal counts are no ties: a limit must be passed. An empty table gives an
    empty table. Columns of ``docs`` are kept inside ``row``, so none can clash.
    """
    names = docs.columns if carry is None else carry
    if clean and text not in names:
        raise ValueError(f"a clean text needs {text} among the columns wanted")
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), text_or_empty(docs, text).alias("in_text"),
                       docs[host].cast("string").alias("in_host"))
    rows = profile(rows, F.col("in_text"), F.col("in_host"))
    rows = rows.drop("in_text", "in_host")
    rows = cut(rows.withColumn("q_id", F.monotonically_increasing_id()), "rules-profiles")
    lines = cut(boilerplate(rows), "rules-lines")
    total = F.aggregate("q_lines", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    each = rows.select("q_id", "q_host", total.alias("total"), F.explode("q_lines").alias("line"))
    gone = (each.join(lines, (each["q_host"] == lines["b_host"]) & (each["line"]["h"] == lines["b_h"]))
            .groupBy("q_id").agg(F.sum("line.n").alias("removed"), F.first("total").alias("total"),
                                 F.count(F.lit(1)).alias("n"), F.collect_set("line.h").alias("hashes")))
    gone = cut(gone.select(F.col("q_id").alias("g_id"), (F.col("total") - F.col("removed") < LEAST_LEFT * F.col("total"))
                           .alias("depleted"), F.col("n").alias("n_removed_lines"), "hashes"), "rules-removed")
    # texts are dealt by document at every size, so that what this moves grows with them evenly
    out = rows.join(gone.hint("merge") if clean else gone.drop("hashes"), rows["q_id"] == gone["g_id"], "left")
    body = F.coalesce(F.col("row").getField(text).cast("string"), F.lit("")) if clean else None
    left = [F.when(F.col("hashes").isNull(), body).otherwise(without_lines(body, F.col("hashes"))).alias("left")] if clean else []
    return out.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce(F.col("depleted"), F.lit(False))).alias("kept"),
        F.coalesce(F.col("n_removed_lines"), F.lit(0)).cast("long").alias("n_removed_lines"), *left)


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
win AS (
  SELECT id, i, len(w) AS n, w[i] || ' ' || coalesce(w[i + 1], '') || ' ' || coalesce(w[i + 2], '') AS s
  FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
rep AS (
  SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, s) AS c FROM win WHERE i <= n - 2) WHERE c > 1),
repeated AS (
  SELECT id, count(*) AS n_repeat_words
  FROM (SELECT DISTINCT id, i + k AS place FROM rep, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY id),
line AS (SELECT id, unnest(string_split(t, chr(10))) AS l FROM d),
dup AS (
  SELECT id, count(*) - count(DISTINCT l) AS n_dup_lines FROM line
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY id),
norm AS (
  SELECT id, trim(lower(regexp_replace(l, '[\x20\x09\x0B-\x0D]+', ' ', 'g'))) AS l FROM line),
many AS (
  SELECT d.host, n.l FROM norm n JOIN d USING (id) WHERE n.l <> '' GROUP BY ALL HAVING count(DISTINCT n.id) > 10),
own AS (
  SELECT n.id, coalesce(string_agg(DISTINCT n.l, chr(10) ORDER BY n.l) FILTER (m.l IS NULL), '') AS others
  FROM norm n JOIN d USING (id) LEFT JOIN many m ON m.host = d.host AND m.l = n.l WHERE n.l <> '' GROUP BY n.id),
frequent AS (
  SELECT d.host, n.l FROM norm n JOIN d USING (id) JOIN many m ON m.host = d.host AND m.l = n.l JOIN own USING (id)
  GROUP BY ALL HAVING count(DISTINCT others) > 10),
left_over AS (
  SELECT n.id, sum(length(n.l)) AS total, coalesce(sum(length(n.l)) FILTER (f.l IS NOT NULL), 0) AS removed,
         count(f.l) AS n_removed_lines
  FROM norm n JOIN d USING (id) LEFT JOIN frequent f ON f.host = d.host AND f.l = n.l WHERE n.l <> '' GROUP BY n.id),
counts AS (
  SELECT id, doc_id, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols
  FROM d)
SELECT c.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
       CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
       n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words)
         AND NOT coalesce(total - removed < 0.2 * total, false) AS kept,
       CAST(coalesce(n_removed_lines, 0) AS BIGINT) AS n_removed_lines
FROM counts c LEFT JOIN repeated USING (id) LEFT JOIN dup USING (id) LEFT JOIN left_over USING (id)
"""


@query("op5_quality_rules", OP5_SQL)
def op5_quality_rules(spark, sf_dir):
    """Counts and verdict of every document; the host is its source."""
    out = judge(documents(spark, sf_dir), carry=["doc_id"])
    return out.select("row.doc_id", *out.columns[1:])
