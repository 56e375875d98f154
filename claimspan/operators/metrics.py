"""Scores of predictions against gold labels, as conditional sums, and bootstrap intervals from counts of label combinations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as V


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(2 * tp + fp + fn > 0, 2.0 * tp / (2 * tp + fp + fn)).otherwise(0.0)


def label_counts(gold: str, predicted: str, label: str, weight: Column | None = None, known_gold_only: bool = False) -> tuple[Column, Column, Column]:
    """True positives, false positives, false negatives. A null prediction counts as a miss. With ``known_gold_only`` a
    prediction on a row of unknown gold label is no false positive."""
    w = F.lit(1) if weight is None else weight
    g, p = F.coalesce(F.col(gold) == label, F.lit(False)), F.coalesce(F.col(predicted) == label, F.lit(False))
    wrong = ~g & p & (F.col(gold).isin(*V.NLI_LABELS) if known_gold_only else F.lit(True))
    return tuple(F.sum(F.when(test, w).otherwise(0)) for test in (g & p, wrong, g & ~p))


def f1_columns(gold: str, predicted: str, weight: Column | None = None, known_gold_only: bool = False) -> list[Column]:
    """Macro-F1 over the three labels, 0 where undefined."""
    each = [_f1(*label_counts(gold, predicted, x, weight, known_gold_only)) for x in V.NLI_LABELS]
    return [F.round((each[0] + each[1] + each[2]) / 3, 6).alias("macro_f1")]


def confusion(rows: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(gold, predicted).agg(F.count("*").alias("n"))


def per_label(rows: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """(label, precision, recall, f1, support) of each label that occurs as gold or prediction; one pass, map-side sums."""
    spread = rows.select(F.explode(F.array_distinct(F.array_compact(F.array(gold, predicted)))).alias("label"), gold, predicted)
    g, p = F.col(gold).eqNullSafe(F.col("label")), F.col(predicted).eqNullSafe(F.col("label"))
    sums = spread.groupBy("label").agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))
    part = lambda other: F.when(F.col("tp") + F.col(other) > 0, F.round(F.col("tp") / (F.col("tp") + F.col(other)), 6)).otherwise(0.0)
    return sums.select("label", part("fp").alias("precision"), part("fn").alias("recall"), F.round(_f1(F.col("tp"), F.col("fp"), F.col("fn")), 6).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def averages(rows: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """(accuracy, macro_precision, macro_recall, macro_f1, weighted_f1, support) over the labels that occur; zeros for an
    empty table. A null prediction is wrong; rows without gold label do not count."""
    known = rows.where(F.col(gold).isNotNull())
    each = per_label(known, gold, predicted)
    right = known.agg(F.coalesce(F.avg((F.col(gold).eqNullSafe(F.col(predicted))).cast("double")), F.lit(0.0)).alias("accuracy"), F.count("*").alias("support"))
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    whole = each.agg(
        mean("precision").alias("macro_precision"), mean("recall").alias("macro_recall"), mean("f1").alias("macro_f1"),
        F.round(F.coalesce(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), F.lit(0.0)), 4).alias("weighted_f1"),
    )
    return right.join(F.broadcast(whole)).select(F.round("accuracy", 4).alias("accuracy"), "macro_precision", "macro_recall", "macro_f1", "weighted_f1", "support")


def unaligned(gold: DataFrame, predictions: DataFrame, by: str = "baseline", key: str = "sample_id") -> DataFrame:
    """(by, key) of gold rows that a baseline has no prediction for."""
    wanted = predictions.select(by).distinct().join(gold.select(key).distinct())
    return wanted.join(predictions.select(by, key).distinct(), [by, key], "left_anti")


def evaluate(gold: DataFrame, predictions: DataFrame, by: str = "baseline", key: str = "sample_id", least_aligned: float = 0.0) -> DataFrame:
    """Per baseline: support, aligned predictions, rates and scores.

    ``gold`` (key, gold), ``predictions`` (by, key, predicted, order): of repeated predictions the last by ``order`` counts.
    Gold rows without prediction are missing, not abstained; a null prediction is an abstention and a miss. A baseline
    whose share of aligned gold rows is below ``least_aligned`` raises an error when the result is computed."""
    last = Window.partitionBy(by, key).orderBy(F.desc("order"))
    newest = predictions.withColumn("k", F.row_number().over(last)).where("k = 1").select(by, key, "predicted")
    size = gold.agg(F.count("*").alias("support"))
    aligned = newest.join(gold.select(key, F.coalesce("gold", F.lit("neutral")).alias("gold")), key)
    tp, fp, fn = label_counts("gold", "predicted", "contradiction")
    scored = aligned.groupBy(by).agg(
        F.count("*").alias("aligned"), F.round(_f1(tp, fp, fn), 6).alias("contradiction_f1"), *f1_columns("gold", "predicted"), F.count_if(F.col("predicted").isNull()).alias("abstained")
    )
    rate = lambda part, whole: F.when(whole > 0, F.round(part / whole, 6)).otherwise(0.0)
    enough = F.col("aligned") >= least_aligned * F.col("support")
    checked = F.when(enough, F.col("support")).otherwise(F.raise_error(F.concat(F.lit("too few aligned predictions of "), F.col(by))).cast("bigint"))
    return scored.join(F.broadcast(size)).withColumn("support", checked).select(
        by, "support", "aligned", "contradiction_f1", "macro_f1", rate(F.col("abstained"), F.col("aligned")).alias("abstention_rate"),
        rate(F.col("support") - F.col("aligned"), F.col("support")).alias("missing_rate"),
    )


#: What labels outside the scored ones count as in resampling; a missing label stays apart, as it is never right.
OTHER, MISSING = "other", "none"


def label_cells(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows by combination of labels, the ones outside NLI_LABELS put together: at most 5 ** len(columns) rows."""
    known = lambda c: F.when(F.col(c).isNull(), MISSING).when(F.col(c).isin(*V.NLI_LABELS), F.col(c)).otherwise(OTHER).alias(c)
    return rows.select(*(known(c) for c in columns)).groupBy(*columns).agg(F.count("*").alias("n"))


def bootstrap(rows: DataFrame, iterations: int, systems: list[str], gold: str = "gold", seed: int = 13) -> DataFrame:
    """(iteration, one macro-F1 column a system) of resamples with replacement.

    A resample of n rows is a multinomial draw of n over the combinations of labels, so each iteration draws counts of at
    most 5 ** (systems + 1) combinations instead of rows; the work does not grow with the table after one counting pass.
    A prediction on a row of unknown gold label is no false positive. An empty table gives 0 everywhere."""
    cells = label_cells(rows, [gold, *systems]).orderBy(gold, *systems).collect()
    counts = np.array([r["n"] for r in cells], np.float64)
    golds = np.array([r[gold] for r in cells])
    predicted = {s: np.array([r[s] for r in cells]) for s in systems}
    scored = np.isin(golds, V.NLI_LABELS)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            drawn = np.array([np.random.default_rng((seed, int(i))).multinomial(int(counts.sum()), counts / counts.sum()) for i in batch["id"]]) if len(counts) else np.zeros((len(batch), 0))
            out = {"iteration": batch["id"].to_numpy()}
            for s, pred in predicted.items():
                total = np.zeros(len(batch))
                for x in V.NLI_LABELS:
                    tp, wrong = drawn[:, (golds == x) & (pred == x)].sum(1), drawn[:, scored & (golds != x) & (pred == x)].sum(1) + drawn[:, (golds == x) & (pred != x)].sum(1)
                    total += np.divide(2.0 * tp, 2 * tp + wrong, out=np.zeros(len(batch)), where=2 * tp + wrong > 0)
                out[f"f1_{s}"] = np.round(total / 3, 6)
            yield pd.DataFrame(out)

    return rows.sparkSession.range(iterations).mapInPandas(draw, ", ".join(["iteration bigint", *(f"f1_{s} double" for s in systems)]))


def significance(rows: DataFrame, baseline: str, systems: list[str], gold: str = "gold", iterations: int = 10_000) -> DataFrame:
    """(system, delta, low, high, p_value, stars) of each system against the baseline: macro-F1 difference, its 95 %
    interval, the share of resamples in which it is not above 0, and stars for p below .05, .01 and .001."""
    samples = bootstrap(rows, iterations, [baseline, *systems], gold)
    deltas = samples.select(F.explode(F.array(*(F.struct(F.lit(s).alias("system"), (F.col(f"f1_{s}") - F.col(f"f1_{baseline}")).alias("d")) for s in systems))).alias("x")).select("x.*")
    values = deltas.groupBy("system").agg(F.sort_array(F.collect_list("d")).alias("v"), (F.count_if(F.col("d") <= 0) / F.count("*")).alias("p_value"))
    at = lambda share: F.round(F.element_at("v", F.least(F.floor(share * F.size("v")).cast("int"), F.size("v") - 1) + 1), 4)
    points = rows.agg(*(f1_columns(gold, s, known_gold_only=True)[0].alias(s) for s in [baseline, *systems]))
    point = points.select(F.explode(F.array(*(F.struct(F.lit(s).alias("system"), F.round(F.col(s) - F.col(baseline), 4).alias("delta")) for s in systems))).alias("x")).select("x.*")
    stars = F.when(F.col("p_value") < 0.001, "***").when(F.col("p_value") < 0.01, "**").when(F.col("p_value") < 0.05, "*").otherwise("")
    return point.join(values, "system").select("system", "delta", at(F.lit(0.025)).alias("low"), at(F.lit(0.975)).alias("high"), "p_value", stars.alias("stars"))


def interval(samples: DataFrame, column: str, confidence: float = 0.95) -> DataFrame:
    """(low, high) by position: the int(alpha * n)-th and the int((1 - alpha) * n)-th of the sorted values, from 0.
    ``samples`` has one row an iteration, a number set by the caller."""
    alpha = (1 - confidence) / 2
    values = samples.agg(F.sort_array(F.collect_list(column)).alias("v"))
    n = F.size("v")
    at = lambda share: F.element_at("v", F.least(F.floor(share * n).cast("int"), n - 1) + 1)
    return values.select(at(F.lit(alpha)).alias("low"), at(F.lit(1 - alpha)).alias("high"))
