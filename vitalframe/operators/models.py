"""Model scoring, evaluation, calibration and fairness."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalframe.functions.exprs import clamp, col, safe_div
from vitalframe.functions.shared import discard, written
from vitalframe.operators.compliance import JsonValue


def linear_score(features, weights: list[float], bias: float) -> Column:
    """Sum of weight * feature plus bias, in 0 to 1. The shorter of the two lists ends the sum."""
    pairs = F.zip_with(F.slice(col(features), 1, len(weights)), F.slice(F.array(*map(F.lit, weights)), F.lit(1), F.least(F.size(col(features)), F.lit(len(weights)))), lambda x, w: x * w)
    return clamp(F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v) + bias, 0.0, 1.0)


def contributions(frame: DataFrame, features: str, names: list[str], weights: list[float], *keep: str) -> DataFrame:
    """(keep, feature, contribution): weight * value, feature by feature."""
    return frame.select(*keep, F.posexplode(features).alias("_i", "_x")).filter(F.col("_i") < len(weights)).select(
        *keep, F.get(F.array(*map(F.lit, names)), F.col("_i")).alias("feature"), (F.get(F.array(*map(F.lit, weights)), F.col("_i")) * F.col("_x")).alias("contribution")
    )


def json_risk(document, features: list[str]) -> Column:
    """Mean of the named numbers that the JSON text has, in 0 to 1; 0 without any. A text of digits is no number."""
    parsed = F.try_parse_json(col(document))
    numbers = F.array_compact(F.array(*[JsonValue.at(parsed, f).number for f in features]))
    return clamp(safe_div(F.aggregate(numbers, F.lit(0.0), lambda s, v: s + v), F.size(numbers), 0.0), 0.0, 1.0)


def stratum(score) -> Column:
    return F.when(col(score) >= 0.7, "High").when(col(score) >= 0.3, "Moderate").otherwise("Low")


def next_steps(frame: DataFrame, score: str, *keep: str) -> DataFrame:
    """(keep, action, priority): two steps for a high, one for a moderate or low risk."""
    step = lambda a, p: F.struct(F.lit(a).alias("action"), F.lit(p).alias("priority"))
    steps = F.when(F.col(score) >= 0.7, F.array(step("flag_high_risk", "high"), step("schedule_follow_up", "medium")))
    steps = steps.when(F.col(score) >= 0.3, F.array(step("monitor", "medium"))).otherwise(F.array(step("routine_care", "low")))
    return frame.select(*keep, F.explode(steps).alias("_s")).select(*keep, "_s.*")


def cohort_report(frame: DataFrame, score: str, group: str) -> DataFrame:
    """(group, n, mean_score, high): size, mean score and high-risk rows of each group."""
    return frame.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.sum((F.col(score) >= 0.7).cast("long")).alias("high"))


def patient_risks(frame: DataFrame, ident: str, document: str, group: str, features: list[str], condition: str, timeframe: str) -> DataFrame:
    """(id, condition, timeframe, score, stratum, group): the risk of each patient by the numbers of their JSON document. group_bias() over it gives the means of the groups."""
    score = json_risk(document, features)
    return frame.select(F.col(ident).alias("id"), F.lit(condition).alias("condition"), F.lit(timeframe).alias("timeframe"), score.alias("score"), F.col(group).alias("group")).withColumn("stratum", stratum("score"))


def note_findings(text) -> Column:
    """A struct of symptoms, medications and sentiment found by word."""
    # The words that are looked for.
    low = F.lower(col(text))
    found = lambda *words: F.array_compact(F.array(*[F.when(low.contains(w), F.lit(w)) for w in words]))
    has = lambda *words: low.contains(words[0]) | low.contains(words[1])
    sentiment = F.when(has("concern", "worsening"), "negative").when(has("improved", "stable"), "positive").otherwise("neutral")
    return F.struct(found("cough", "fever").alias("symptoms"), found("metformin", "aspirin").alias("medications"), sentiment.alias("sentiment"))


def confusion(frame: DataFrame, label: Column, score: str, threshold: float = 0.5, *by: str) -> DataFrame:
    """tp, fp, tn, fn with precision, recall, f1 and accuracy; 0 for a zero denominator."""
    positive = F.col(score) >= threshold
    count = lambda c: F.sum(c.cast("long"))
    counts = frame.groupBy(*by).agg(count(label & positive).alias("tp"), count(~label & positive).alias("fp"), count(~label & ~positive).alias("tn"), count(label & ~positive).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.withColumns({
        "precision": safe_div(tp, tp + fp, 0.0), "recall": safe_div(tp, tp + fn, 0.0), "f1": safe_div(2 * tp, 2 * tp + fp + fn, 0.0), "accuracy": safe_div(tp + tn, tp + fp + tn + fn, 0.0),
    })


def roc_points(frame: DataFrame, label: Column, score: str, thresholds: list[float]) -> DataFrame:
    """(threshold, fpr, tpr): one aggregate over the rows for all thresholds; 0 for a zero denominator."""
    count = lambda c: F.sum(c.cast("long"))
    named = [F.struct(F.lit(t).alias("threshold"), F.col(f"_t{i}").alias("tp"), F.col(f"_f{i}").alias("fp")) for i, t in enumerate(thresholds)]
    sums = [x for i, t in enumerate(thresholds) for x in (count(label & (F.col(score) >= t)).alias(f"_t{i}"), count(~label & (F.col(score) >= t)).alias(f"_f{i}"))]
    one = frame.agg(count(label).alias("_p"), count(~label).alias("_n"), *sums)
    points = one.select("_p", "_n", F.explode(F.array(*named)).alias("x"))
    return points.select("x.threshold", safe_div("x.fp", "_n", 0.0).alias("fpr"), safe_div("x.tp", "_p", 0.0).alias("tpr"))


def auc_of_points(points: DataFrame) -> DataFrame:
    """One row: the area under (fpr, tpr) points by trapezoids; 0 for fewer than two. Points are few: one per threshold."""
    order = Window.orderBy("fpr", "tpr")
    part = (F.col("fpr") - F.lag("fpr").over(order)) * (F.col("tpr") + F.lag("tpr").over(order)) / 2
    return points.select(part.alias("_a")).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("auc"))


def auc_rank(frame: DataFrame, label: Column, score: str, buckets: int = 32) -> DataFrame:
    """One row: the rank statistic with average ranks for ties; 0.5 with one class only, 0 without rows.

    Rows without a score, or with NaN, are left out. Rows are counted by distinct score, these are cut into buckets by approximate quantiles (at most
    `buckets` numbers on the driver), and the rows before a score are those of lower buckets plus a
    running count inside its own, so no window holds all scores.
    """
    cells = frame.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).groupBy(F.col(score).cast("double").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(label.cast("long")).alias("p"))
    cells = written(cells)  # read three times
    edges = sorted(set(cells.approxQuantile("s", [i / buckets for i in range(1, buckets)], 0.01)))
    bucket = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("s"))) if edges else F.lit(0)
    cells = cells.withColumn("b", bucket)
    sizes = cells.groupBy("b").agg(F.sum("n").alias("bn"))
    before = sizes.withColumn("base", F.sum("bn").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bn")).select("b", "base")
    inside = F.sum("n").over(Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
    ranked = cells.withColumn("upto", inside).join(F.broadcast(before), "b")
    mean_rank = F.col("base") + F.col("upto") - (F.col("n") - 1) / 2
    one = ranked.agg(F.sum("p").cast("double").alias("np"), F.sum(F.col("n") - F.col("p")).cast("double").alias("nn"), F.sum(F.col("p") * mean_rank).alias("r"))
    area = safe_div(F.col("r") - F.col("np") * (F.col("np") + 1) / 2, F.col("np") * F.col("nn"), 0.5)
    return one.select(F.coalesce(area, F.lit(0.0)).alias("auc"))


def brier(frame: DataFrame, label: Column, score: str, *by: str) -> DataFrame:
    gap = F.col(score) - label.cast("double")
    return frame.groupBy(*by).agg(F.avg(gap * gap).alias("brier"))


def calibration_error(frame: DataFrame, label: Column, score: str, bins: int) -> DataFrame:
    """One row: expected calibration error over equal bins of the score."""
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    cells = frame.groupBy(at.alias("_b")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("c"), F.avg(label.cast("double")).alias("a"))
    return cells.agg(safe_div(F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))), F.sum("n"), 0.0).alias("ece"))


def parity_gap(frame: DataFrame, score: str, group: str, a, b, threshold: float = 0.5) -> DataFrame:
    """One row: difference of the positive rates of two groups; an empty group has rate 0."""
    rate = lambda g: F.coalesce(F.avg(F.when(F.col(group) == g, (F.col(score) >= threshold).cast("double"))), F.lit(0.0))
    return frame.agg(F.abs(rate(a) - rate(b)).alias("gap"))


def opportunity_gap(frame: DataFrame, label: Column, score: str, group: str, a, b, threshold: float = 0.5) -> DataFrame:
    """One row: difference of the true positive rates of two groups."""
    return parity_gap(frame.filter(label), score, group, a, b, threshold)


def group_bias(frame: DataFrame, score: str, group: str) -> DataFrame:
    return frame.groupBy(group).agg(F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("n"))


#: What a metric needs: aggregates of the label, the score and whether it reaches the threshold. All of a list are one aggregate.
def _ratio(top, bottom) -> Column:
    return safe_div(F.sum(top.cast("double")), F.sum(bottom.cast("double")), 0.0)


METRICS = {
    "accuracy": lambda y, s, p: F.coalesce(F.avg((y == p).cast("double")), F.lit(0.0)),
    "precision": lambda y, s, p: _ratio(y & p, p),
    "recall": lambda y, s, p: _ratio(y & p, y),
    "specificity": lambda y, s, p: _ratio(~y & ~p, ~y),
    "f1": lambda y, s, p: safe_div(2 * F.sum((y & p).cast("double")), F.sum(y.cast("double")) + F.sum(p.cast("double")), 0.0),
    "brier": lambda y, s, p: F.coalesce(F.avg((s - y.cast("double")) * (s - y.cast("double"))), F.lit(0.0)),
    "log_loss": lambda y, s, p: F.coalesce(F.avg(-F.ln(clamp(F.when(y, s).otherwise(1 - s), 1e-15, 1.0))), F.lit(0.0)),
    "ece": lambda y, s, p: safe_div(sum((F.abs(F.sum(F.when(F.least(F.floor(s * 10), F.lit(9)) == b, s - y.cast("double")).otherwise(0.0))) for b in range(10)), F.lit(0.0)), F.count(F.lit(1)), 0.0),
}


def validate_model(frame: DataFrame, label: Column, score: str, metrics: list, threshold: float = 0.5, *by: str) -> DataFrame:
    """(by, metric, value): all metrics in one pass over the rows.

    metrics: names of METRICS, or pairs of a name and a function of label, score and prediction that gives an aggregate. Rows without label
    or score are left out; without rows there is one row of zeros a metric where no groups are asked for.
    """
    named = [(m, METRICS[m]) if isinstance(m, str) else m for m in metrics]
    rows = frame.select(*by, label.alias("_y"), F.col(score).cast("double").alias("_s")).filter("_y is not null and _s is not null and not isnan(_s)")
    y, s, p = F.col("_y"), F.col("_s"), F.col("_s") >= threshold
    one = rows.groupBy(*by).agg(*[f(y, s, p).alias(f"_m{i}") for i, (_, f) in enumerate(named)])
    values = F.array(*[F.struct(F.lit(n).alias("metric"), F.coalesce(F.col(f"_m{i}").cast("double"), F.lit(0.0)).alias("value")) for i, (n, _) in enumerate(named)])
    return one.select(*by, F.explode(values).alias("_x")).select(*by, "_x.*")


def importance_rows(frame: DataFrame, features: list[str], model, *keep: str, magnitudes: list[float] | None = None) -> DataFrame:
    """(keep, importance array): how much each feature moves the model's output at each row.

    model: a function from a matrix (a row for each case, a column for each feature) to its outputs. Each feature is moved by 1e-3
    times its magnitude both ways; the importance is the mean of the slope's size and of the larger change of the output.
    The copies of a batch are scored in one call. Null features count as 0.
    """
    step, size = 1e-3, np.ones(len(features)) if magnitudes is None else np.maximum(np.abs(magnitudes), 1e-6)
    rows = frame.select(*keep, F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]).alias("importance"))

    def score(batches):
        for batch in batches:
            x = np.array(batch.column("importance").to_pylist(), float).reshape(batch.num_rows, len(features))
            moves = np.concatenate([np.zeros((1, len(features))), np.diag(step * size), -np.diag(step * size)])
            y = np.asarray(model((x[None, :, :] + moves[:, None, :]).reshape(-1, len(features))), float).reshape(len(moves), len(x)) if len(x) else np.zeros((len(moves), 0))
            up, down = y[1 : 1 + len(features)], y[1 + len(features) :]
            found = 0.5 * (np.abs(up - down) / (2 * step) + np.maximum(np.abs(up - y[0]), np.abs(down - y[0])))
            columns = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "importance"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(found.T), pa.list_(pa.float64()))], names=batch.schema.names)

    return rows.mapInArrow(score, rows.schema)


def feature_importance(frame: DataFrame, features: list[str], model, magnitudes: list[float] | None = None) -> DataFrame:
    """(feature, importance): the mean of importance_rows() for each feature."""
    each = importance_rows(frame, features, model, magnitudes=magnitudes)
    means = each.agg(*[F.avg(F.col("importance")[i]).alias(f"_f{i}") for i in range(len(features))])
    return means.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"_f{i}").alias("importance")) for i, n in enumerate(features)])).alias("_x")).select("_x.*")


def platt_fit(frame: DataFrame, label: Column, score: str, rate: float, steps: int, start: tuple[float, float] = (0.0, 0.0), smooth: bool = True) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a s + b))) by gradient descent; one aggregate a step over rows counted by (score, label) first, which are written once."""
    cells = written(frame.groupBy(F.col(score).cast("double").alias("s"), label.alias("y")).agg(F.count(F.lit(1)).cast("double").alias("n")))
    totals = cells.agg(F.sum(F.when(F.col("y"), F.col("n")).otherwise(0.0)), F.sum("n")).first()
    positive, every = totals[0] or 0.0, totals[1] or 0.0
    if not every:
        return start
    high = (positive + 1) / (positive + 2) if smooth else 1.0
    low = 1 / (every - positive + 2) if smooth else 0.0
    a, b = start
    for _ in range(steps):
        miss = (1 / (1 + F.exp(-(F.col("s") * a + b))) - F.when(F.col("y"), high).otherwise(low)) * F.col("n")
        ga, gb = cells.agg(F.sum(miss * F.col("s")), F.sum(miss)).first()
        a, b = a - rate * ga / every, b - rate * gb / every
        if max(abs(ga), abs(gb)) / every < 1e-8:
            break
    discard(cells)
    return a, b


def quantize(x, scale: float) -> Column:
    """x / scale rounded half away from zero, in -127 to 127, as a byte."""
    return F.least(F.greatest(F.round(col(x) / scale), F.lit(-127.0)), F.lit(127.0)).cast("tinyint")


def dequantize(q, scale: float) -> Column:
    """The inverse of quantize(), but for the rounding."""
    return col(q).cast("double") * scale


def symmetric_scale(frame: DataFrame, x: str) -> DataFrame:
    """One row: largest absolute value / 127."""
    return frame.agg((F.max(F.abs(F.col(x).cast("double"))) / 127).alias("scale"))


def lung_nodules(images, sensitivity: str = "standard") -> Column:
    """A placeholder's struct: candidate count (images less one) and a confidence by sensitivity (low .6, high .8, else .7)."""
    return F.struct(F.greatest(F.size(col(images)) - 1, F.lit(0)).alias("count"), F.lit({"low": 0.6, "high": 0.8}.get(sensitivity, 0.7)).alias("confidence"))


@dataclass(frozen=True)
class LinearModel:
    weights: list[float]
    bias: float

    @classmethod
    def load(cls, path: str) -> LinearModel:
        found = json.loads(Path(path).read_text())
        return cls(found["weights"], found["bias"])

    def score(self, features) -> Column:
        return linear_score(features, self.weights, self.bias)

    def issues(self) -> list[str]:
        """What is odd about the weights."""
        w = self.weights
        tests = [
            (not w, "no weights"), (len(w) > 1024, "over 1024 weights"), (any(map(math.isnan, w)), "NaN weights"),
            (any(abs(x) > 10 for x in w), "weights over 10 in size"), (any(x < 0 for x in w), "negative weights"),
        ]
        return [message for broken, message in tests if broken]


@dataclass
class ModelRegistry:
    """Models by id and version (three numbers)."""

    models: dict[str, dict[tuple[int, int, int], object]] = field(default_factory=dict)

    def register(self, name: str, version: str, model) -> None:
        self.models.setdefault(name, {})[self.parse(version)] = model

    @staticmethod
    def parse(version: str) -> tuple[int, int, int]:
        major, minor, patch = (int(x) for x in version.split("."))
        return major, minor, patch

    def get(self, name: str, version: str | None = None):
        """The model of a version, or of the highest; None if absent."""
        found = self.models.get(name, {})
        return found.get(self.parse(version)) if version else found[max(found)] if found else None
