"""The packaged lexicon and the small one that the test tables can match."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lexspan.schema import LEXICON

# Words that the test tables hold.
FIXTURE = (("the", "le_x", "fixture"), ("and", "plus", "fixture"), ("de", "of", "fixture"), ("la", "so", "fixture"), ("is", "be", "fixture"), ("schein", "glow", "fixture"))


def packaged_rows() -> list[tuple[str, str, str]]:
    file = Path(__file__).resolve().parent.parent / "data" / "lexicon.tsv"
    return [tuple(x.split("\t")) for x in file.read_text(encoding="utf-8").splitlines() if x and not x.startswith("#")]


def packaged(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(packaged_rows(), LEXICON)


def fixture(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FIXTURE), LEXICON)


def from_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A lexicon of one's own: key, replacement and, if there, family, tab-separated; of equal keys the last counts for none, so they are refused."""
    rows = spark.read.csv(path, sep="\t", schema=LEXICON, comment="#")
    if not rows.groupBy("key").count().where("count > 1").isEmpty():
        raise ValueError("a key occurs twice")
    return rows
