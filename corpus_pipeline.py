"""A corpus made ready for training, stage by stage.

Every stage takes what the one before kept, as the columns of ``documents``; what
a stage decides takes effect. The last one gives token ids.

All stages: an empty table gives an empty table; other columns pass untouched, whatever their
names, up to the last stage, which gives its own; very long texts are one row throughout. Null and
empty texts fail the quality rules; given to a later stage they stay as they are, have no words, near
copies or personal data, are not taken by the mix and have no ids. Repeated rows are judged each;
the near-duplicate stage keeps one of a group, the least by its key and then by a hash of its text; the mix
takes equal rows together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salestally.llm import bpe, jaccard, mixing, pii, rules
from salestally.llm.common import documents
from salestally.session import cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counts and are more than boilerplate, without the lines that are; the length follows."""
    kept = rules.judge(docs, clean=True).where("kept")
    shorter = F.col("n_removed_lines") > 0
    made = {"text": F.col("left"), "n_chars": F.when(shorter, F.length("left").cast("long")).otherwise(F.col("row").getField("n_chars"))
            if "n_chars" in docs.columns else None}
    return kept.select(*[made[c].alias(c) if c in made else F.col("row").getField(c).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; the length follows the text."""
    out = pii.mask(docs, pii.fit(docs))
    lengths = [c for c in docs.columns if c == "n_chars"]
    return out.withColumns({c: F.length("text").cast("long") for c in lengths})


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.Mix(docs).documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids, and whether they give the text back."""
    both = bpe.encode_and_decode(docs.select("doc_id", "source", "text"), bpe.default_tokenizer())
    return both.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", near_duplicates),
    ("pii", personal_data),
    ("mixing", mix),
    ("bpe", token_ids),
]

# personal data and token ids are beyond SQL; tests compare with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again by the next."""
    out = documents(spark, sf_dir)
    for name, stage in STAGES:
        out = cut(stage(spark, out, sf_dir), f"pipeline-{name}")
    return out
