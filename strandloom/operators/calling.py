"""Calling of modified bases and labels of reads."""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions.columns import motif_positions

# executors need not have the package: functions travel whole
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def call_tm(
    df: DataFrame, x: str, expected_t: str, expected_b: str, base: str, significant: float = 0.4, out: str = "called",
    near: float | None = None, both: tuple[str, str] | None = None,
) -> DataFrame:
    """At bases T: X where both expectations differ by significant or less, else B or T, whichever is nearer to x (T if equal).

    near: X too where neither expectation lies nearer than that. both, a read's key and order, couples each step with the one before, of any base: a step
    counts if one of the two does, two that count and disagree make X, B needs both, or one where the other's pair does not count;
    a read's first step is never B. Steps without an expectation don't count then.
    """
    gap_t, gap_b = F.abs(F.col(x) - F.col(expected_t)), F.abs(F.col(x) - F.col(expected_b))
    counts = F.abs(F.col(expected_t) - F.col(expected_b)) > significant
    if near is not None:
        counts = counts & (F.least(gap_t, gap_b) < near)
    if both is None:
        call = F.when(~counts, "X").when(gap_b < gap_t, "B").otherwise("T")
        return df.withColumn(out, F.when(F.col(base) == "T", call).otherwise(F.col(base)))
    w = Window.partitionBy(both[0]).orderBy(both[1])
    df = df.withColumns({"__s": F.coalesce(counts, F.lit(False)), "__b": F.coalesce(gap_b < gap_t, F.lit(False))})
    df = df.withColumn("__p", F.col("__s") | F.lag("__s", 1, False).over(w))
    before, b_before = F.lag("__p").over(w), F.lag("__b").over(w)
    df = df.withColumns({"__v": F.coalesce(before, F.lit(False)), "__f": before.isNull(), "__a": b_before})
    b = F.when(F.col("__f"), False).when(F.col("__v"), F.col("__b") & F.col("__a")).otherwise(F.col("__b"))
    call = F.when(~F.col("__p") | (F.col("__v") & (F.col("__b") != F.col("__a"))), "X").when(b, "B").otherwise("T")
    return df.withColumn(out, F.when(F.col(base) == "T", call).otherwise(F.col(base))).drop("__s", "__b", "__p", "__v", "__f", "__a")


@dataclass(frozen=True)
class Logistic:
    """Scores windows by a logistic function of their mean, deviation and size, in Spark's own functions; null for empty ones."""

    weights: tuple[float, float, float]
    bias: float

    def column(self, values: str) -> Column:
        x, n = F.col(values), F.when(F.size(values) > 0, F.size(values)).cast("double")
        mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
        # the mean is a field, so that it is not summed again for each value
        spread = F.aggregate(
            x, F.struct(F.lit(0.0).alias("q"), mean.alias("m")),
            lambda a, v: F.struct((a.q + (v - a.m) * (v - a.m)).alias("q"), a.m.alias("m")),
            lambda a: F.struct(a.m.alias("m"), F.sqrt(a.q / n).alias("d")),
        )
        return F.transform(
            F.array(spread), lambda s: 1 / (1 + F.exp(-(self.weights[0] * s.m + self.weights[1] * s.d + self.weights[2] * n + self.bias)))
        )[0]


class Model:
    """A model as it travels to workers: pickled and broadcast once, unpacked once in each worker process."""

    def __init__(self, spark: SparkSession, model):
        self.held = spark.sparkContext.broadcast(cloudpickle.dumps(model))

    def get(self):
        # a worker keeps one object for each broadcast, whatever the task
        if not hasattr(self.held, "unpacked"):
            self.held.unpacked = pickle.loads(self.held.value)
        return self.held.unpacked


def predictions(model, windows: list, n_outputs: int, batch: int = 1024) -> np.ndarray:
    """(n_outputs, windows): what model.predict gives for windows of values or of channels; nan for null ones. Windows of one length are predicted together."""
    out = np.full((n_outputs, len(windows)), np.nan)
    lengths: dict[int, list[int]] = {}
    for i, v in enumerate(windows):
        if v is not None:
            lengths.setdefault(len(v), []).append(i)
    for places in lengths.values():
        for k in range(0, len(places), batch):
            at = places[k : k + batch]
            x = np.array([np.array([np.asarray(c, float) for c in windows[i]]) for i in at])
            found = model.predict(x[..., None] if x.ndim == 2 else x)
            found = [found] if n_outputs == 1 and not isinstance(found, list | tuple) else found
            if len(found) != n_outputs:
                raise ValueError(f"the model gives {len(found)} outputs instead of {n_outputs}")
            for row, one in zip(out, found, strict=True):
                row[at] = np.asarray(one, float).reshape(len(at), -1)[:, 0]
    return out


def score_windows(windows: DataFrame, keys: list[str], values: str, model, outputs: tuple[str, ...] = ("score",)) -> DataFrame:
    """(keys..., outputs...): scores of windows, whose values are an array of numbers or of channels at each position.

    model is an object with column(values), an expression of one score, or with predict(x), which takes an array (windows, positions, channels) and returns an array of a
    score a window, or a list of such arrays for several outputs; it must be picklable. It is broadcast once and fed batches. Scores of null windows, and scores that are not a number, are null.
    """
    if hasattr(model, "column"):
        (name,) = outputs
        return windows.select(*keys, model.column(values).alias(name))
    types = dict(windows.dtypes)
    held = Model(windows.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = predictions(held.get(), batch.column(values).to_pylist(), len(outputs))
            columns = [*(batch.column(k) for k in keys), *(pa.array(row, pa.float64(), mask=np.isnan(row)) for row in found)]
            yield pa.RecordBatch.from_arrays(columns, [*keys, *outputs])

    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), *(f"{o} double" for o in outputs)])
    return windows.select(*keys, values).mapInArrow(run, schema)


def relabel_reads(reads: DataFrame, seq: str, mean: str, threshold: float, mod: str, bounds: tuple[float, float] | None = None, motif: str | None = None, out: str = "labelled") -> DataFrame:
    """Sequences with T as the modification's letter in reads whose mean is threshold or more: all of them, or those of the motif.

    Reads whose mean lies outside bounds go.
    """
    if bounds:
        reads = reads.filter(F.col(mean).between(*bounds))
    if motif:
        full = F.replace(F.col(seq), F.lit(motif), F.lit(motif.replace("T", mod)))
    else:
        full = F.replace(F.col(seq), F.lit("T"), F.lit(mod))
    return reads.withColumn(out, F.when(F.col(mean) >= threshold, full).otherwise(F.col(seq)))


def relabel_positions(df: DataFrame, base: str, p: str, threshold: Column | float, mod: str, out: str = "labelled") -> DataFrame:
    """T as the modification's letter where p exceeds the threshold, a number or a k-mer's own."""
    hit = (F.col(base) == "T") & (F.col(p) > threshold)
    return df.withColumn(out, F.when(F.coalesce(hit, F.lit(False)), F.lit(mod)).otherwise(F.col(base)))


def motif_sites(reads: DataFrame, key: str, seq: str, motif: str) -> DataFrame:
    return reads.select(key, F.explode(motif_positions(seq, motif)).alias("pos"))


def template_offset(template: DataFrame, signal: DataFrame, key: str, idx: str, value: str, most: int = 5000, limit: float = 100.0) -> DataFrame:
    """(key, offset, gap): where the short template lies in the signal of the same read: the offset, up to most, of the smallest mean squared
    difference, the first of equal ones; reads whose gap exceeds limit go. Only offsets at which the whole template fits count.

    Template and signal meet in stretches of most positions, so that places further apart than that make no pairs."""
    t = template.select(key, F.col(idx).alias("__i"), F.col(value).alias("__t"), F.explode(F.expr(f"array({idx} div {most}, {idx} div {most} + 1)")).alias("__at"))
    s = signal.select(key, F.col(idx).alias("__j"), F.col(value).alias("__s"), F.expr(f"{idx} div {most}").alias("__at"))
    size = template.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    offset = (F.col("__j") - F.col("__i")).alias("offset")
    pairs = t.join(s, [key, "__at"]).filter((F.col("__j") >= F.col("__i")) & (F.col("__j") - F.col("__i") <= most))
    gap = F.sum((F.col("__t") - F.col("__s")) * (F.col("__t") - F.col("__s"))).alias("__q")
    at = pairs.groupBy(key, offset).agg(gap, F.count(F.lit(1)).alias("__c")).join(size, key).filter("__c = __n")
    at = at.withColumn("gap", F.col("__q") / F.col("__n"))
    best = at.groupBy(key).agg(F.min(F.struct("gap", "offset")).alias("x")).select(key, "x.offset", "x.gap")
    return best.filter(F.col("gap") <= limit)


#: Window lengths, thresholds and heights of peaks of the detector's presets, fixed values.
PRESETS = {
    "r9.4": ((3, 6), (1.4, 1.1), 0.2),
    "r9": ((6, 12), (2.0, 1.1), 1.2),
    "r9.5b": ((4, 5), (1.4, 1.0), 1.0),
    "r9.5": ((4, 6), (1.4, 1.0), 0.65),
    "rf": ((4, 6), (1.4, 1.1), 1.2),
}


class _Detector:
    """Follows one statistic and reports its peaks: rises of height above the last low, confirmed by a fall of height."""

    def __init__(self, width: int, threshold: float, height: float):
        self.width, self.threshold, self.height = width, threshold, height
        self.reset(np.inf)

    def reset(self, low: float) -> None:
        self.at, self.value, self.sure = None, low, False

    def rising(self, i: int, v: float) -> bool:
        """Takes a value; whether a peak is being followed already."""
        if self.at is not None:
            if v > self.value:
                self.at, self.value = i, v
            return True
        if v < self.value:
            self.value = v
        elif v - self.value > self.height:
            self.at, self.value = i, v
        return False

    def confirmed(self, i: int, v: float) -> int | None:
        """The peak's place once it is sure and half a window behind."""
        self.sure = self.sure or (self.value - v > self.height and self.value > self.threshold)
        if not (self.sure and i - self.at > self.width / 2):
            return None
        peak = self.at
        self.reset(v)
        return peak


def find_peaks(short: np.ndarray, long: np.ndarray, widths, thresholds, height: float) -> list[int]:
    """Peaks of two statistics; one of the short windows silences the long ones around it."""
    a, b = (_Detector(w, t, height) for w, t in zip(widths, thresholds, strict=True))
    silent_to, peaks = 0, []
    for i, (u, v) in enumerate(zip(short, long, strict=True)):
        if a.rising(i, u):
            if a.value > a.threshold:
                silent_to = a.at + a.width
                b.reset(np.inf)
            if (p := a.confirmed(i, u)) is not None:
                peaks.append(p)
        if i > silent_to and b.rising(i, v) and (p := b.confirmed(i, v)) is not None:
            peaks.append(p)
    return peaks


def detect_events(df: DataFrame, x: str, key: str, idx: str, preset: str = "r9.5") -> DataFrame:
    """(key, peak): ends of events, by t-statistics over two window lengths. One read's statistics meet in a task."""
    from .series import tstat

    (wa, wb), thresholds, height = PRESETS[preset]
    df = tstat(tstat(df, x, wa, key, idx, "__a"), x, wb, key, idx, "__b")

    def run(read: pd.DataFrame) -> pd.DataFrame:
        read = read.sort_values(idx)
        peaks = find_peaks(read["__a"].to_numpy(), read["__b"].to_numpy(), (wa, wb), thresholds, height)
        return pd.DataFrame({key: [read[key].iloc[0]] * len(peaks), "peak": read[idx].to_numpy()[peaks]})

    types = dict(df.dtypes)
    return df.select(key, idx, "__a", "__b").groupBy(key).applyInPandas(run, f"{key} {types[key]}, peak {types[idx]}")


def best_partition(x: np.ndarray, gamma: float, shortest: int, longest: int) -> list[int]:
    """Ends (exclusive) of the segments of shortest to longest values, of least squared error plus gamma a segment."""
    s, q = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(x * x)])
    n = len(x)
    cost, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    cost[0] = 0.0
    for end in range(shortest, n + 1):
        begin = np.arange(max(0, end - longest), end - shortest + 1)
        total = s[end] - s[begin]
        error = q[end] - q[begin] - total * total / (end - begin)
        options = cost[begin] + gamma + error
        best = int(options.argmin())
        cost[end], back[end] = options[best], begin[best]
    if not np.isfinite(cost[n]):
        return [n]
    ends, at = [], n
    while at > 0:
        ends.append(at)
        at = back[at]
    return ends[::-1]


def optimal_segments(df: DataFrame, x: str, key: str, idx: str, gamma: float = 0.1, shortest: int = 1, longest: int = 10) -> DataFrame:
    """(key, seg, start, length, mean, std) of each read's best partition. One read's values meet in a task."""

    def run(read: pd.DataFrame) -> pd.DataFrame:
        v = read.sort_values(idx)[x].to_numpy(float)
        ends = best_partition(v, gamma, shortest, longest)
        starts = [0, *ends[:-1]]
        parts = [v[a:b] for a, b in zip(starts, ends, strict=True)]
        return pd.DataFrame({key: read[key].iloc[0], "seg": range(len(ends)), "start": starts, "length": [len(p) for p in parts], "mean": [p.mean() for p in parts], "std": [p.std() for p in parts]})

    schema = f"{key} {dict(df.dtypes)[key]}, seg int, start int, length int, mean double, std double"
    return df.select(key, idx, x).groupBy(key).applyInPandas(run, schema)
