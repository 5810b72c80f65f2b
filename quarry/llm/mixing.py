"""Mixing sources to target weights by iterative proportional fitting.

Token counts by cell (source, language, topic) are raked: factors of each
dimension's values are scaled in turn until the weighted tokens meet the target
share of every value. The weights give keep probabilities, and each document is
kept or not by a hash of its id against its cell's probability. The probabilities
are calibrated so that the expected tokens kept are a stated share; where that
clips many cells at 1, the sample stays between the observed shares and the
targets. Without a stated share (``keep=None``) it is the largest that clips no
cell, and the expected sample meets the targets as the weights do.

DataFrame functions only. A pass over the documents makes the cells. Up to
``broadcast_cells`` cells, all rounds are one expression over one row of arrays:
each dimension's values hold the positions of their cells, and a round is a fold
over them. Beyond that the same rounds are joins and aggregations of a table of
cells, settled after each round. Either way the driver sees no cell but their
number. Cells are broadcast to the documents in the first case and joined by
shuffle in the second.

Defined results: a null source or language is a value of its own; a null or
empty text has no tokens but its cell's probability; a null id is hashed as the
text "null"; rows that repeat an id are kept or dropped together within a cell,
and each by its own cell's probability in different ones; a null topic is a value
of its own; an empty table gives no rows; the columns of the input are kept.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import settle, settle_table

DIMENSIONS = ("source", "lang", "topic")


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic from marks in the text; the first that fits."""
    return (
        F.when(text.contains(" | "), "table")
        .when(text.contains("License") | text.contains("rights reserved"), "legal")
        .when(text.contains("@") | text.contains("://"), "contact")
        .when(text.contains("?"), "question")
        .when(F.length(text) >= 2000, "article")
        .otherwise("note")
    )


def unit_hash(key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def _with_goals(cells: DataFrame, temper: float, targets: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """``cells`` with all tokens (``everything``) and, for each dimension, the tokens that its value
    should have. Without given shares, the observed ones to the power ``temper``, normalised."""
    total = cells.agg(F.sum("tokens").cast("double").alias("everything"))
    out = cells.join(F.broadcast(total), F.lit(True)).withColumn("weight", F.lit(1.0))
    for dim in DIMENSIONS:
        seen = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("t"))
        given = targets.get(dim)
        if given is None:
            raised = seen.select(dim, F.pow("t", F.lit(temper)).alias("g"))
        else:
            share = F.create_map(*(x for k, v in given.items() for x in (F.lit(k), F.lit(float(v)))))
            raised = seen.select(dim, F.coalesce(F.element_at(share, F.col(dim)), F.lit(0.0)).alias("g"))
        raised = raised.join(F.broadcast(raised.agg(F.sum("g").alias("all"))), F.lit(True)).select(dim, (F.col("g") / F.col("all")).alias(f"goal_{dim}"))
        out = out.join(raised, dim)
    return out


def rake(cells: DataFrame, temper: float, rounds: int, targets: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Cells (source, lang, topic, tokens > 0) with ``weight``, after ``rounds`` over
    all dimensions; each round is settled as a table, so plans stay short."""
    state = settle_table(_with_goals(cells, temper, targets))
    for _ in range(rounds):
        for dim in DIMENSIONS:
            have = F.sum(F.col("tokens") * F.col("weight"))
            factor = state.groupBy(dim).agg(F.when(have > 0, F.max(f"goal_{dim}") / have).otherwise(0.0).alias("f"))
            state = state.join(factor, dim).withColumn("weight", F.col("weight") * F.col("f") * F.col("everything")).drop("f")
        state = settle_table(state)
    return state


def calibrate(cells: DataFrame, keep: float | None, steps: int) -> DataFrame:
    """``cells`` with ``probability`` = min(1, c * weight), c set so that ``keep`` of
    all tokens are expected to stay: cells that reach 1 count whole and c is set
    anew for the others, ``steps`` times. Without ``keep``, c is 1 over the largest weight."""
    scale = cells.agg((F.lit(1.0) / F.max("weight") if keep is None else F.lit(keep)).alias("c"))
    for _ in range(0 if keep is None else steps):
        full = F.col("c") * F.col("weight") >= 1
        fixed = F.sum(F.when(full, F.col("tokens")).otherwise(0)).cast("double")
        free = F.sum(F.when(~full, F.col("tokens") * F.col("weight")).otherwise(0.0))
        sums = cells.join(F.broadcast(scale), F.lit(True)).agg(fixed.alias("fixed"), free.alias("free"), F.max("c").alias("old"), F.max("everything").alias("e"))
        scale = sums.select(F.when(F.col("free") > 0, F.greatest((F.lit(keep) * F.col("e") - F.col("fixed")) / F.col("free"), F.lit(0.0))).otherwise(F.col("old")).alias("c"))
    return cells.join(F.broadcast(settle(scale)), F.lit(True)).withColumn("probability", F.least(F.lit(1.0), F.col("c") * F.col("weight"))).drop("c")


def _let(name: str, value: str, body: str) -> str:
    """SQL of ``body``, in which ``name`` is ``value``, computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _round_sql(weights: str, dims: tuple[str, ...] = DIMENSIONS) -> str:
    """SQL of the weights after each of ``dims`` in turn has been scaled to its goals."""
    if not dims:
        return weights
    dim, w, f = dims[0], f"w_{dims[0]}", f"f_{dims[0]}"
    have = f"aggregate(v.cells, 0D, (s, i) -> s + get(held, i) * get({w}, i))"
    factors = f"transform(by_{dim}, v -> {_let('h', have, 'if(h > 0, v.goal / h, 0D)')})"
    scaled = _let(f, factors, f"transform({w}, (x, i) -> x * get({f}, get({dim}_of, i)) * everything)")
    return _let(w, weights, _round_sql(scaled, dims[1:]))


def _scale_sql(keep: float | None, steps: int) -> str:
    """SQL of what weights are multiplied with: see ``calibrate``."""
    if keep is None:
        return "1D / array_max(weights)"
    fixed = "s.fixed + if(c * get(weights, i) >= 1, get(held, i), 0D)"
    free = "s.free + if(c * get(weights, i) >= 1, 0D, get(held, i) * get(weights, i))"
    sums = f"aggregate(sequence(0, size(held) - 1), named_struct('fixed', 0D, 'free', 0D), (s, i) -> named_struct('fixed', {fixed}, 'free', {free}))"
    anew = _let("t", sums, f"if(t.free > 0, greatest(({float(keep)!r}D * everything - t.fixed) / t.free, 0D), c)")
    return f"aggregate(slice(sequence(0, {steps}), 2, {steps}), {float(keep)!r}D, (c, k) -> {anew})"


def _raked_row(cells: DataFrame, temper: float, rounds: int, targets: Mapping[str, Mapping[str, float]], keep: float | None, steps: int) -> DataFrame:
    """Cells with ``weight`` and ``probability``: what ``rake`` and ``calibrate`` give, from one row that
    holds all cells, in their order, and for each dimension its values' goals and cells."""
    ranks = [f"cast(dense_rank() OVER (ORDER BY {dim}) - 1 AS int) AS {dim}_at" for dim in DIMENSIONS]
    numbered = cells.selectExpr("*", *ranks, f"cast(row_number() OVER (ORDER BY {', '.join(DIMENSIONS)}) - 1 AS int) AS cell")
    # every cell counts for one value of each dimension; those of the first dimension give the cells
    named = ", ".join(f"'{dim}', {dim}, '{dim}_at', {dim}_at" for dim in DIMENSIONS)
    listed = ", ".join(f"'{dim}', {dim}, {dim}_at" for dim in DIMENSIONS)
    counted = numbered.selectExpr(f"named_struct('cell', cell, 'tokens', cast(tokens AS double), {named}) AS c", f"stack({len(DIMENSIONS)}, {listed}) AS (dim, value, at)")
    values = counted.groupBy("dim", "at", "value").agg(F.sum("c.tokens").alias("seen"), F.array_sort(F.collect_list("c")).alias("own"))
    lists = [f"array_sort(collect_list(if(dim = '{dim}', named_struct('at', at, 'value', value, 'seen', seen, 'cells', own.cell), NULL))) AS {dim}s" for dim in DIMENSIONS]
    row = values.groupBy().agg(F.expr(f"array_sort(flatten(collect_list(if(dim = '{DIMENSIONS[0]}', own, NULL)))) AS cells"), *map(F.expr, lists)).filter("size(cells) > 0")
    row = row.selectExpr("*", "cells.tokens AS held", f"aggregate({DIMENSIONS[0]}s, 0D, (s, v) -> s + v.seen) AS everything", *(f"cells.{dim}_at AS {dim}_of" for dim in DIMENSIONS))
    for dim in DIMENSIONS:
        given = targets.get(dim)
        share = F.create_map(*(x for k, v in given.items() for x in (F.lit(k), F.lit(float(v))))) if given else F.expr("map('', 0D)")
        asked = "pow(v.seen, temper)" if given is None else "coalesce(try_element_at(share, v.value), 0D)"
        row = row.withColumns({"temper": F.lit(float(temper)), "share": share}).withColumn("asked", F.expr(f"transform({dim}s, v -> {asked})"))
        all_of = "aggregate(asked, 0D, (s, g) -> s + g)"
        row = row.withColumn(f"by_{dim}", F.expr(_let("total", all_of, f"transform({dim}s, (v, i) -> named_struct('goal', get(asked, i) / total, 'cells', v.cells))")))
    row = settle(row.select("cells", "held", "everything", *(f"{dim}_of" for dim in DIMENSIONS), *(f"by_{dim}" for dim in DIMENSIONS)))
    weights = f"aggregate(slice(sequence(0, {rounds}), 2, {rounds}), transform(held, x -> 1D), (w, k) -> {_round_sql('w')})"
    row = settle(row.withColumn("weights", F.expr(weights))).withColumn("scale", F.expr(_scale_sql(keep, steps)))
    each = row.selectExpr("scale", "explode(arrays_zip(cells, weights)) AS c")
    return each.selectExpr(*(f"c.cells.{dim}" for dim in DIMENSIONS), "c.weights AS weight", "least(1D, scale * c.weights) AS probability")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    temper: float = 0.7,
    keep: float | None = 0.9,
    rounds: int = 8,
    steps: int = 4,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    broadcast_cells: int = 100_000,
    topic: str | Column | None = None,
) -> DataFrame:
    """All rows and columns of ``docs`` with ``_topic``, ``_tokens``, ``_weight``, ``_probability`` and ``_selected``.
    ``topic`` is a column of ``docs`` (or an expression over them) that holds the topic, such as a
    model's; without one it is the coarse rule of ``topic_of``."""
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("∅"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    of = topic_of(text) if topic is None else name(topic) if isinstance(topic, str) else F.coalesce(topic.cast("string"), F.lit("∅"))
    # the input's columns travel as one struct, so no name of theirs can clash
    own = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), name(source_col).alias("_source"), name(lang_col).alias("_lang"), of.alias("_topic"), token_count(text).alias("_tokens")
    )
    cells = settle(own.groupBy(F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic")).agg(F.sum("_tokens").alias("tokens")))
    few = cells.count() <= broadcast_cells
    if few:
        # so few rows are one task's
        cells = cells.coalesce(1)
    counted = cells.filter("tokens > 0")
    weighed = _raked_row(counted, temper, rounds, targets or {}, keep, steps) if few else calibrate(rake(counted, temper, rounds, targets or {}), keep, steps)
    empty = cells.filter("tokens = 0").select(*DIMENSIONS, F.lit(1.0).alias("weight"), F.lit(1.0).alias("probability"))
    table = settle(weighed.select(*DIMENSIONS, "weight", "probability").unionByName(empty)).toDF("_source", "_lang", "_topic", "_weight", "_probability")
    if few:
        table = F.broadcast(table)
    return (
        own.join(table, ["_source", "_lang", "_topic"])
        .withColumn("_selected", unit_hash(F.col(f"_row.`{id_col}`")) < F.col("_probability"))
        .select(*(F.col(f"_row.`{c}`") for c in docs.columns), *(F.col(c).alias(f"_{c}" if c in docs.columns else c) for c in ("_topic", "_tokens", "_weight", "_probability", "_selected")))
    )


def oracle(temper: float = 0.7, keep: float = 0.9, rounds: int = 8, steps: int = 4) -> str:
    """DuckDB SQL for the query's rows: the same rounds, unrolled."""
    parts = ["""own AS (
  SELECT doc_id, coalesce(source, '∅') AS source, coalesce(lang, '∅') AS lang,
    CASE WHEN contains(t, ' | ') THEN 'table' WHEN contains(t, 'License') OR contains(t, 'rights reserved') THEN 'legal'
         WHEN contains(t, '@') OR contains(t, '://') THEN 'contact' WHEN contains(t, '?') THEN 'question'
         WHEN length(t) >= 2000 THEN 'article' ELSE 'note' END AS topic,
    len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS tokens
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)
)""", """cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM own GROUP BY ALL)""",
        "s0 AS (SELECT *, 1.0::DOUBLE AS weight, sum(tokens) OVER () AS everything FROM cells WHERE tokens > 0)"]
    for d in DIMENSIONS:
        parts.append(f"goal_{d} AS (SELECT {d}, pow(sum(tokens), {temper}) / sum(pow(sum(tokens), {temper})) OVER () AS goal FROM s0 GROUP BY {d})")
    last, k = "s0", 0
    for _ in range(rounds):
        for d in DIMENSIONS:
            k += 1
            parts.append(
                f"s{k} AS MATERIALIZED (SELECT c.* EXCLUDE (weight), c.weight * (g.goal / sum(c.tokens * c.weight) OVER (PARTITION BY c.{d})) * c.everything AS weight FROM {last} c JOIN goal_{d} g USING ({d}))"
            )
            last = f"s{k}"
    parts.append(f"p0 AS (SELECT *, least(1.0, {keep} * weight) AS probability FROM {last})")
    for k in range(1, steps + 1):
        parts.append(
            f"p{k} AS MATERIALIZED (SELECT * EXCLUDE (probability, fixed, free), CASE WHEN probability >= 1 OR free <= 0 THEN probability ELSE least(1.0, greatest(({keep} * everything - fixed) / free, 0.0) * weight) END AS probability "
            f"FROM (SELECT *, sum(CASE WHEN probability >= 1 THEN tokens ELSE 0 END) OVER () AS fixed, sum(CASE WHEN probability < 1 THEN tokens * weight ELSE 0 END) OVER () AS free FROM p{k - 1}))"
        )
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT o.doc_id, o.topic, o.tokens::BIGINT AS tokens, round(coalesce(p.weight, 1.0), 6) AS weight, round(coalesce(p.probability, 1.0), 6) AS probability,
  ('0x' || substr(md5(o.doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < coalesce(p.probability, 1.0) AS selected
FROM own o LEFT JOIN p{steps} p USING (source, lang, topic)"""
    )
