"""Evaluation questions and answer probes from JSON lines, with their rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The categories and splits of questions.
CATEGORIES = ("factual", "cross_language", "multi_document", "identifier", "table", "accentless", "inflection", "unanswerable")
SPLITS = ("dev", "holdout")

_COMMON = "id string, lang string, query string, answerable boolean, category string, split string, family string"
QUESTIONS = f"{_COMMON}, relevant array<struct<document:string,contains:string>>, require_all boolean"
PROBES = f"{_COMMON}, expect array<string>"


class DatasetError(ValueError):
    """Rows that break a rule of the data set."""


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    lines = spark.read.text(path).filter(F.trim("value") != "")
    known = [f.split()[0] for f in schema.replace(":", " ").split(", ") if f]
    read = lines.select("value", F.from_json("value", schema).alias("r"), F.json_object_keys("value").alias("keys"))
    wrong = read.filter(F.col("r").isNull() | F.col("keys").isNull() | (F.size(F.array_except("keys", F.array(*map(F.lit, known)))) > 0) | F.col("r.id").isNull() | F.col("r.query").isNull() | F.col("r.answerable").isNull())
    if row := wrong.select("value").first():
        raise DatasetError(f"not a row of this data set: {row['value'][:200]}")
    return read.select("r.*")


def _check(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The first row that a rule calls wrong is an error; so is an id that repeats."""
    broken = F.coalesce(*(F.when(wrong, F.lit(says)) for says, wrong in rules.items()))
    if row := rows.select("id", broken.alias("says")).filter("says IS NOT NULL").first():
        raise DatasetError(f"{row['id']}: {row['says']}")
    if row := rows.groupBy("id").count().filter("count > 1").first():
        raise DatasetError(f"{row['id']}: the id repeats")
    return rows


def _grouping() -> dict[str, Column]:
    category, split = F.col("category"), F.col("split")
    return {
        "unknown category": category.isNotNull() & ~category.isin(*CATEGORIES),
        "unknown split": split.isNotNull() & ~split.isin(*SPLITS),
        "unanswerable is a category of its own": category.isNotNull() & ((category == "unanswerable") == F.col("answerable")),
    }


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    rows = _read(spark, path, QUESTIONS).withColumns({"require_all": F.coalesce("require_all", F.lit(False)), "relevant": F.coalesce("relevant", F.array().cast("array<struct<document:string,contains:string>>"))})
    labels = F.size("relevant")
    rules = {
        "answerable questions have labels, others none": F.col("answerable") != (labels > 0),
        "require_all needs two labels": F.col("require_all") & (labels < 2),
        "require_all and multi_document go together": F.col("category").isNotNull() & (F.col("require_all") != (F.col("category") == "multi_document")),
    }
    _check(rows, rules | _grouping())
    evidence = rows.select("split", F.explode("relevant").alias("e")).select("split", F.struct("e.document", "e.contains").cast("string").alias("key"))
    families = rows.filter("family IS NOT NULL").select("split", F.concat(F.lit("family "), "family").alias("key"))
    leaks = evidence.unionByName(families).filter("split IS NOT NULL").groupBy("key").agg(F.countDistinct("split").alias("n")).filter("n > 1")
    if row := leaks.first():
        raise DatasetError(f"{row['key']} is in more than one split")
    return rows


def load_probes(spark: SparkSession, path: str) -> DataFrame:
    rows = _read(spark, path, PROBES).withColumn("expect", F.coalesce("expect", F.array().cast("array<string>")))
    empty = F.exists("expect", lambda e: F.exists(F.split(e, r"\|", -1), lambda a: F.trim(a) == ""))
    _check(rows, {"answerable probes expect texts, others none": F.col("answerable") != (F.size("expect") > 0), "an alternative is empty": empty} | _grouping())
    if not rows.filter("answerable").count():
        raise DatasetError("no answerable probe")
    return rows


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON lines in a new place; an old one is never overwritten."""
    report.write.mode("errorifexists").json(path)


def to_markdown(report: DataFrame, rows: int = 1000) -> str:
    """A report's rows as a Markdown table."""
    cell = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [report.columns, ["---"] * len(report.columns), *(map(cell, r) for r in report.limit(rows).collect())]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"
