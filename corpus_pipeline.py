"""Training-corpus pipeline: quality, near-dedup, decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes every stage's result as
Parquet to the shared folder and reads it again as the next one's documents. All stages but the last return the columns
of ``documents``; columns that a user adds pass through, whatever their names. In every stage a null text counts as an
empty one, very long texts count whole, and an empty table gives no rows.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.llm.common import cut, drop, table
from quantspark.llm.decontaminate import without_contaminated
from quantspark.llm.mixing import mix_rows
from quantspark.llm.neardup import NearDupConfig, keep_one_of_each
from quantspark.llm.quality import score_quality, train_quality
from quantspark.llm.secrets import redact, secret_spans


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; repeated rows score alike. Without labels every score is 0.5 and
    no document is good."""
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).where("predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the smallest doc_id. Repeated rows
    stay once; documents without words are nobody's copies and stay."""
    return keep_one_of_each(docs, NearDupConfig(words=5))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows with one doc_id go together. Without items all stay."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret span replaced by a mark and n_chars counted anew where the text changed. Repeated
    rows repeat; a null text stays null."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")  # no name can clash
    cleaned = redact(secret_spans(packed))
    changed = F.col("text").isNotNull() & (F.col("text") != F.col("row.text"))

    def column(c: str) -> F.Column:
        own = F.col(f"row.`{c}`")
        if c == "n_chars":
            own = F.when(changed, F.length("text").cast(docs.schema[c].dataType)).otherwise(own)
        return (F.col("text") if c == "text" else own).alias(c)

    return cleaned.select(*[column(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their number of copies. Repeated rows tie, and are taken together."""
    return mix_rows(docs).where("copies > 0")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixing", mixing),
]

#: A trained classifier decides, which SQL can't express; the tests hold the stages after it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            made = cut(made)
            drop(docs)  # but for the input, what the stage before has written
        docs = made
    return docs
