"""A cleaning pipeline over the documents: toxic ones go, one of each group of near-duplicates stays, benchmark passages go,
personal data is masked, and what is left is mixed to target weights.

Each stage is (name, function); a function takes (spark, docs, sf_dir), sees all rows that its predecessor kept, and returns a
DataFrame that is written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regrove.llm.common import table, written
from regrove.llm.decontaminate import find_contamination
from regrove.llm.mixing import mix
from regrove.llm.pii import find_pii, redacted
from regrove.llm.simhash import drop_near_duplicates
from regrove.llm.toxicity import score_toxicity


def plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`docs` under names that no operator uses, and each column's new name: extra columns can then have any name."""
    return docs.toDF(*[f"column_{i}" for i in range(len(docs.columns))]), {c: f"column_{i}" for i, c in enumerate(docs.columns)}


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of the toxicity model.

    Null and empty texts are scored like any other (they have no toxic words); repeated rows share one score; an empty table stays empty.
    """
    rows, name = plain(docs)
    scored = score_toxicity(rows, table(spark, sf_dir, "labels"), keep=tuple(rows.columns), id=name["doc_id"], text=name["text"])
    return scored.where("predicted = 0").select(*rows.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id, null ids last) of each group whose fingerprints over four-word shingles hang together by 4 bits or fewer.

    Null and wordless texts are one group; repeated rows leave one; an empty table stays empty.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten benchmark words occurs (null, empty and wordless texts among them); an empty table stays empty."""
    rows, name = plain(docs)
    found = find_contamination(rows, table(spark, sf_dir, "benchmark"), keep=tuple(rows.columns), text=name["text"], items=False)
    return found.where("n_hit = 0").select(*rows.columns).toDF(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind; n_chars follows the text where it had counted it.

    Null and empty texts stay as they are; repeated rows are masked alike; an empty table stays empty.
    """
    rows, name = plain(docs)
    found = find_pii(rows, keep=tuple(rows.columns), text=name["text"])
    # a column of its own: inside its lambdas the text's name must not mean the new text
    found = found.withColumn("masked", redacted(F.col(name["text"]), F.col("pii_spans")))
    new = {name["text"]: F.col("masked")}
    if "n_chars" in name:
        new[name["n_chars"]] = F.when(F.size("pii_spans") > 0, F.length("masked").cast("long")).otherwise(F.col(name["n_chars"]))
    return found.select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns]).toDF(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies and words that the mix takes of each document: null texts have size 0, repeated rows a row each; an empty table gives an empty mix."""
    return mix(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing),
]

#: Trees, fingerprints and draws aren't SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
