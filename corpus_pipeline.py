"""The corpus pipeline: toxicity, near duplicates, benchmark leaks, secrets, source mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next stage's ``docs``. All stages but
the last return the columns of ``documents``, with whatever extra columns came,
also where their names clash with those of an operator. Stages read other tables
of ``sf_dir`` (labels, benchmark) by Spark's reader.

An empty table passes through every stage. Rows with a null or empty text are
kept: they are not toxic unless all learned rows are, have no near duplicates,
no windows and no secrets, and weigh nothing in the mix. Null ids and sources
pass; repeated rows are one near-duplicate group, of which one row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysieve.llm.common import Scratch, table
from skysieve.llm.decontamination import decontaminate
from skysieve.llm.jaccard_join import join_components
from skysieve.llm.mixing import mix
from skysieve.llm.secret_scan import scan_secrets
from skysieve.llm.toxicity import fit, score


def _carried(docs: DataFrame) -> DataFrame:
    """(row, text): whole rows as one column, so that no name clashes and every column comes through an operator."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the lexicon, learned on these rows and their labels, does not call toxic; with no labels, all rows. Repeated rows share their fate."""
    lexicon = fit(docs, table(spark, sf_dir, "labels"))
    return score(_carried(docs), lexicon, id_col="row", held_out=False).filter("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked documents: that with the smallest id (null ids last), then the smallest text digest.

    Rows without words link with nothing and all stay.
    """
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    known = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), digest.alias("digest"))
    found = join_components(docs.select(known.alias("known"), "text"), id_col="known")
    first = found.filter("set_id IS NOT NULL AND known = component_id").select("known")
    stays = Scratch(spark, "stays").keep(first.groupBy("known").count(), "stays")
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = docs.filter(~wordless).join(stays.select(F.col("known").alias("stays")), known == F.col("stays"), "left_semi")
    if not stays.filter("count > 1").isEmpty():  # rows that repeat id and text
        names = kept.columns
        kept = kept.withColumn("_text_digest", digest).dropDuplicates(["doc_id", "_text_digest"]).select(*(f"`{c}`" for c in names))
    return docs.filter(wordless).unionByName(kept)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of a benchmark item; rows without words, and all rows where there are no items, stay."""
    return decontaminate(_carried(docs), table(spark, sf_dir, "benchmark"), id_col="row").filter("n_hit = 0").select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets in their texts replaced and ``n_chars`` counted again where a text changed; null texts stay null."""
    found = scan_secrets(_carried(docs), id_col="row", redact=REDACTED)
    changed = F.size("spans") > 0
    new = {"text": F.col("redacted"), "n_chars": F.when(changed, F.length("redacted").cast("long")).otherwise(F.col("row.n_chars"))}
    return found.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each row the mix takes (see ``mix``); rows without words take none."""
    return mix(docs)


#: What stands in a text where a secret was.
REDACTED = "[secret]"

STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: The toxicity stage is learned, so SQL cannot give run()'s rows; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else scratch.keep(out, name.replace(" ", "-"))
    return docs
