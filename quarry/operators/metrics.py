"""Retrieval and answer metrics as aggregations over all questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text

#: How far beside a percentile its bounds are looked for.
BESIDE = 0.005


def label_ranks(ranked: DataFrame, labels: DataFrame) -> DataFrame:
    """(qid, label, rank): the first position whose chunk is of the label's document
    and holds its text; null if none. ``ranked``: qid, rank, document, text;
    ``labels``: qid, label, document, contains."""
    hay = ranked.select("qid", "document", "rank", text.squash("text").alias("hay"))
    met = labels.join(hay, ["qid", "document"]).filter(F.contains("hay", text.squash("contains")))
    first = met.groupBy("qid", "label").agg(F.min("rank").alias("rank"))
    return labels.select("qid", "label").join(first, ["qid", "label"], "left")


def question_scores(ranks: DataFrame, questions: DataFrame, context: int = 8) -> DataFrame:
    """One row per question (qid, require_all, ...): found at 5, at 10 and in the
    context, reciprocal rank and nDCG at 10. Labels are alternatives unless all are required."""
    at_most = lambda k: F.coalesce(F.col("rank") <= k, F.lit(False))
    place = Window.partitionBy("qid").orderBy(F.col("rank").asc_nulls_last(), "label")
    placed = ranks.withColumn("j", F.row_number().over(place)).withColumn("position", F.greatest("rank", "j"))
    gain = lambda p: 1 / F.log2(p + 1.0)
    per = placed.groupBy("qid").agg(
        *(f(at_most(k)).alias(f"{n}_{k}") for k in {5, 10, context} for n, f in (("all", F.bool_and), ("any", F.bool_or))),
        F.min("rank").alias("first"),
        F.when(F.count("rank") == F.count("*"), F.max("rank")).alias("last"),
        F.sum(F.when(F.col("rank").isNotNull() & (F.col("position") <= 10), gain(F.col("position"))).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("j") <= 10, gain(F.col("j"))).otherwise(0.0)).alias("ideal"),
    )
    every = F.col("require_all")
    found = lambda k: F.coalesce(F.when(every, F.col(f"all_{k}")).otherwise(F.col(f"any_{k}")), F.lit(False))
    answered = F.when(every, F.col("last")).otherwise(F.col("first"))
    answered = F.when(answered <= 10, answered)
    ndcg = F.when(every, F.col("dcg") / F.col("ideal")).otherwise(gain(answered))
    return questions.join(per, "qid", "left").select(
        *(F.col(c) for c in questions.columns),
        found(5).alias("found_at_5"),
        found(10).alias("found_at_10"),
        found(context).alias("in_context"),
        F.coalesce(1 / answered, F.lit(0.0)).alias("reciprocal_rank"),
        F.coalesce(ndcg, F.lit(0.0)).alias("ndcg"),
    )


def group_means(scores: DataFrame, places: int = 6, by: list[str] | None = None) -> DataFrame:
    """Means overall, per category and per split, in one pass; with ``by`` within each of its
    groups, and with how many questions miss the context and candidates were ``skipped``."""
    by = by or []
    named = scores.withColumns({"category": F.coalesce("category", F.lit("uncategorized")), "split": F.coalesce("split", F.lit("unsplit"))})
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), places)
    more = [F.sum((~F.col("in_context")).cast("long")).alias("missed"), F.sum("skipped").alias("skipped")] if by else []
    sets = named.groupingSets([by, [*by, "category"], [*by, "split"]], *by, "category", "split").agg(
        F.grouping_id().alias("g"),
        F.count("*").alias("queries"),
        mean("found_at_5").alias("recall_at_5"),
        mean("found_at_10").alias("recall_at_10"),
        mean("reciprocal_rank").alias("mrr_at_10"),
        mean("ndcg").alias("ndcg_at_10"),
        mean("in_context").alias("in_context"),
        *more,
    )
    kind = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "category").otherwise("split")
    shown = ["queries", "recall_at_5", "recall_at_10", "mrr_at_10", "ndcg_at_10", "in_context", *(["missed", "skipped"] if by else [])]
    return sets.select(*by, kind.alias("kind"), F.coalesce("category", "split", F.lit("all")).alias("key"), *shown)


def nearest_rank(p: float, value: str | Column) -> Column:
    """Nearest-rank percentile: the value at rank max(1, ceil(p% of n))."""
    return F.expr(f"percentile_disc({p / 100}) within group (order by {value})").cast("double")


def nearest_ranks(rows: DataFrame, by: str, value: str, percents: dict[str, float]) -> DataFrame:
    """``nearest_rank`` of each of ``percents`` (name to percent) for few groups of many values, null groups and NaN
    included: (by, n, names). An aggregate of all values of a group would meet in one task. Here approximate
    percentiles 10 times their error beside the rank bound it; values below are only counted, and
    of those between, about a hundredth, distinct ones are ranked."""
    names, v = list(percents), F.nanvl(F.col(value).cast("double"), F.lit(float("inf")))
    beside = [min(1.0, max(0.0, p / 100 + side * BESIDE)) for p in percents.values() for side in (-1, 1)]
    bounds = rows.groupBy(F.col(by).alias("_g")).agg(F.count(value).alias("n"), F.percentile_approx(v, beside, round(10 / BESIDE)).alias("_b"))
    near = rows.select(by, value).join(F.broadcast(bounds), F.col(by).eqNullSafe(F.col("_g")))
    low, high = (lambda i: F.get("_b", F.lit(2 * i))), (lambda i: F.get("_b", F.lit(2 * i + 1)))
    below = near.groupBy("_g").agg(*(F.count(F.when(v < low(i), 1)).alias(f"_below{i}") for i in range(len(names))))
    which = F.array(*(F.when((v >= low(i)) & (v <= high(i)), i) for i in range(len(names))))
    counts = near.select("_g", "n", F.col(value).alias("_v"), F.explode(F.array_compact(which)).alias("_i")).groupBy("_g", "n", "_i", "_v").agg(F.count("*").alias("_c"))
    left = F.element_at(F.array(*(F.col(f"_below{i}") for i in range(len(names)))), F.col("_i") + 1)
    upto = left + F.sum("_c").over(Window.partitionBy("_g", "_i").orderBy("_v"))
    rank = F.greatest(F.lit(1), F.ceil(F.col("n") * F.element_at(F.array(*(F.lit(p / 100) for p in percents.values())), F.col("_i") + 1)))
    ranked = counts.join(F.broadcast(below.withColumnRenamed("_g", "_h")), F.col("_g").eqNullSafe(F.col("_h"))).withColumn("_reached", upto >= rank)
    found = ranked.filter("_reached").groupBy("_g").agg(*(F.min(F.when(F.col("_i") == i, F.col("_v"))).cast("double").alias(name) for i, name in enumerate(names)))
    return bounds.drop("_b").withColumnRenamed("_g", by).join(F.broadcast(found), F.col(by).eqNullSafe(F.col("_g")), "left").select(by, "n", *names)


def share(part: Column, whole: Column) -> Column:
    """Null, never zero, over nothing."""
    return F.when(whole > 0, part / whole)


def confusion(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``answerable`` and ``abstained`` as a matrix; unanswerable is positive."""
    return _rated(outcomes.groupBy(*(by or [])).agg(*_matrix()))


def _matrix() -> list[Column]:
    n = lambda a, b: F.sum(F.when((F.col("answerable") == a) & (F.col("abstained") == b), 1).otherwise(0)).cast("long")
    return [n(False, True).alias("true_positive"), n(True, True).alias("false_positive"), n(True, False).alias("true_negative"), n(False, False).alias("false_negative")]


def _rated(counted: DataFrame) -> DataFrame:
    tp = F.col("true_positive")
    return counted.withColumn("precision", share(tp, tp + F.col("false_positive"))).withColumn("recall", share(tp, tp + F.col("false_negative")))


def answer_metrics(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rates over probes: valid_citations, cited_evidence, found, expected (counts), answerable,
    abstained, uncited, finish_reason. Rows whose ``by`` is null are left out."""
    for c in by or []:
        outcomes = outcomes.filter(F.col(c).isNotNull())
    return outcomes.groupBy(*(by or [])).agg(*_rates())


def _rates() -> list[Column]:
    answered, answerable = ~F.col("abstained"), F.col("answerable")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return [
        F.count("*").alias("probes"),
        share(n(answered & F.col("valid_citations")), n(answered)).alias("valid_citation_rate"),
        share(n(answerable & F.col("cited_evidence")), n(answerable)).alias("cited_evidence_coverage"),
        share(n(answerable & (F.col("found") == F.col("expected"))), n(answerable)).alias("expected_fact_rate"),
        F.avg(F.when(answerable, F.col("found") / F.col("expected"))).alias("coverage"),
        n(F.col("uncited")).alias("uncited"),
        *(n(F.col("finish_reason") == r).alias(f"finish_{r}") for r in ("stop", "length", "repetition")),
    ]


def answer_summary(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """All that is told of answers, in one pass: rates, the matrix of abstention, complete answers, refusals
    of either kind, the share of YES verdicts and the mean share of distinct lines."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    answerable, refused = F.col("answerable"), F.col("abstained")
    more = [
        n(answerable & (F.col("found") == F.col("expected"))).alias("complete"),
        n(answerable & refused).alias("refused_answerable"),
        n(~answerable & refused).alias("refused_unanswerable"),
        F.avg(F.col("verdict").cast("int")).alias("judge_yes_rate"),
        F.avg("distinct_line_ratio").alias("mean_distinct_line_ratio"),
    ]
    return _rated(outcomes.groupBy(*by).agg(*_rates(), *_matrix(), *more))


def answer_counts(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many answers are complete (answerable and all expected facts found) and how many refuse."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    complete = F.col("answerable") & (F.col("found") == F.col("expected"))
    return outcomes.groupBy(*(by or [])).agg(n(complete).alias("complete"), n(F.col("abstained")).alias("refused"))


def score_answers(answers: DataFrame) -> DataFrame:
    """``answers`` (answerable, abstained, citations, invalid_citations, cited_texts, evidence) with ``valid_citations``
    (some, and none invalid) and ``cited_evidence``: the answer is given, was to be given, and a cited text holds the evidence."""
    valid = (F.size("citations") > 0) & (F.size("invalid_citations") == 0)
    shown = F.exists("cited_texts", lambda t: F.exists("evidence", lambda e: t.contains(e)))
    return answers.withColumns({"valid_citations": valid, "cited_evidence": F.col("answerable") & ~F.col("abstained") & shown})


def judged_rate(verdicts: DataFrame, verdict: str = "verdict", by: list[str] | None = None) -> DataFrame:
    """Share of YES among the verdicts that are given; null if none is."""
    return verdicts.groupBy(*(by or [])).agg(F.avg(F.col(verdict).cast("int")).alias("yes_rate"), F.count(verdict).alias("judged"))


def split_leaks(items: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that occur in more than one split."""
    return items.groupBy(key).agg(F.countDistinct(split).alias("splits")).filter("splits > 1")


def bench_gate(runs: DataFrame, least_speed_up: float = 5.0, most_recall_change: float = 0.02) -> DataFrame:
    """One row per tier of (tier, device, warm, ms, found, wanted, recall): medians of warm runs
    by device, the speed-up, and whether it passes: fast enough, no fewer facts than
    the CPU found (less one at most than were wanted there), recall hardly changed."""
    by = runs.groupBy("tier", "device").agg(
        F.median(F.when(F.col("warm"), F.col("ms"))).alias("ms"), F.max("found").alias("found"), F.max("wanted").alias("wanted"), F.max("recall").alias("recall")
    )
    side = lambda d: by.filter(F.col("device") == d).select("tier", *(F.col(c).alias(f"{d}_{c}") for c in ("ms", "found", "wanted", "recall")))
    both = side("cpu").join(side("gpu"), "tier").withColumn("speed_up", F.round(F.col("cpu_ms") / F.col("gpu_ms"), 3))
    sound = (F.col("cpu_found") + 1 >= F.col("cpu_wanted")) & (F.col("gpu_found") >= F.col("cpu_found"))
    near = F.abs(F.col("gpu_recall") - F.col("cpu_recall")) <= most_recall_change
    return both.withColumn("passes", (F.col("speed_up") >= least_speed_up) & sound & near)
