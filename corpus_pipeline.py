"""A corpus pipeline: stages over documents, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and reread before the next stage. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import classifier, mixing, packing, secrets, simhash
from ledgerloom.llm.common import Scratch, table
from ledgerloom.plans.shipping import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Tokens wanted of each domain, in proportion; the stage takes no document twice.
MIX = {"clean": 0.97, "low": 0.02, "toxic": 0.01}
#: SQL cannot express a learned classifier, learned automata or a fitted mixture.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good stay."""
    model = classifier.train(docs, table(spark, sf_dir, "labels"))
    return classifier.scored(docs.select(*COLUMNS), model).where("score >= 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group stays, one row of it.

    Groups are of texts with a similarity of 0.8 or more on five-word shingles.
    Documents without a word have no shingle and are left as they are, as are
    rows without an id.
    """
    docs = docs.select(*COLUMNS)
    has_word = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]") & F.col("doc_id").isNotNull()
    found = simhash.similar(docs.where(has_word), width=5)
    kept = Scratch(spark, "kept").keep(found.where("doc_id = component_id").select("doc_id").distinct())
    # of a repeated id the row that is least in order, whichever task comes first
    rest = [c for c in COLUMNS if c != "doc_id"]
    first = docs.where(has_word).join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("row")).select("doc_id", "row.*")
    return first.select(*COLUMNS).unionByName(docs.where(~has_word))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; n_chars follows the text."""
    return secrets.scan(docs, keep=COLUMNS, mark="[{kind}]").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay with the probability of their fitted rate."""
    found = mixing.mix(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), MIX, repeat=False)
    return found.where("copies > 0").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return packing.pack(docs)


STAGES = [("quality_classifier", quality), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("mixing", mixture), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    ship(spark)
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
