"""Replication forks from labelled reads: segments, tracts, their directions, initiations and terminations.

Gates, smoothing and scaling are windows and aggregates over all reads; what depends on the order of decisions
within a read runs on its corner points, a read at a time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.series import running_mean

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Settings:
    """Limits of the detection; the defaults are those of letters called by transitions, RATIO those of ratios."""

    min_std: float = 0.3
    smoothing: int = 32
    min_amplitude: float = 0.5
    tolerance: float = 0.25
    min_jump: float = 0.44
    low_plateau: float = 0.12
    min_distance: float = 1000
    score: float = 2
    jump_score: float = 1
    flank: float = 500
    spike: float = 1000
    mirror: bool = False


LETTERS = Settings()
RATIO = Settings(min_std=0.115, smoothing=30, min_amplitude=0.4, low_plateau=0.14)


@dataclass
class Tract:
    start: float
    end: float
    jump_score: float
    dir: str = "?"
    score: float = 0.0

    def holds(self, other: Tract) -> bool:
        return self.start <= other.start < self.end


def gated_signal(df: DataFrame, key: str, idx: str, x: str, y: str, settings: Settings) -> DataFrame:
    """(key, idx, x, yr): smoothed values scaled to 0..1, of the reads that vary enough before and after smoothing."""
    return _scaled(df, key, idx, {"yr": (y, settings)}).filter("yr is not null").select(key, idx, x, "yr")


def _scaled(df: DataFrame, key: str, idx: str, tracks: dict[str, tuple[str, Settings]]) -> DataFrame:
    """Adds out: (y, settings): y smoothed over the positions where it is known and scaled to 0..1, null at others and in reads that vary too little.

    All tracks of a read are made where its rows meet, in one exchange.
    """
    read = Window.partitionBy(key)
    df = df.withColumns({f"__std_{out}": F.stddev_pop(y).over(read) for out, (y, _) in tracks.items()})
    smooth = {}
    for out, (y, s) in tracks.items():
        # positions without a value go into a part of their own
        known = Window.partitionBy(key, F.col(y).isNull()).orderBy(idx)
        smooth[f"__y_{out}"] = F.when(F.col(y).isNotNull() & (F.col(f"__std_{out}") > s.min_std), running_mean(y, s.smoothing, key, idx, known))
    df = df.withColumns(smooth)
    ends = {f"__{f.__name__}_{out}": f(f"__y_{out}").over(read) for out in tracks for f in (F.min, F.max)}
    df = df.withColumns(ends)
    new = {}
    for out, (_, s) in tracks.items():
        lo, wide = F.col(f"__min_{out}"), F.col(f"__max_{out}") - F.col(f"__min_{out}")
        new[out] = F.when(wide > s.min_amplitude, (F.col(f"__y_{out}") - lo) / wide)
    return df.withColumns(new).drop(*[f"__{k}_{out}" for out in tracks for k in ("std", "y", "min", "max")])


def corner_points(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Indices of the polyline that keeps all points within tolerance of it (Ramer, Douglas and Peucker)."""
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    todo = [(0, len(x) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        # the root of the squares, as in SQL: hypot may differ in the last bit, which decides between points that are equally far away
        length = np.sqrt(dx * dx + dy * dy)
        away = np.abs(dx * py - dy * px) / length if length else np.hypot(px, py)
        far = int(away.argmax())
        if away[far] > tolerance:
            keep[a + 1 + far] = True
            todo += [(a, a + 1 + far), (a + 1 + far, b)]
    return np.nonzero(keep)[0]


def flatten_spikes(x: np.ndarray, y: np.ndarray, width: float) -> np.ndarray:
    """y with narrow spikes at the mean of their neighbours; later corners see earlier changes."""
    y = y.copy()
    for i in range(1, len(x) - 1):
        left, right = y[i - 1], y[i + 1]
        narrow = abs(x[i + 1] - x[i - 1]) < width and abs(right - left) < 0.3
        if narrow and max(abs(right - y[i]), abs(left - y[i])) > 0.6:
            y[i] = (left + right) / 2
    return y


def without_spikes(signal: DataFrame, key: str, idx: str, x: str, y: str, width: float) -> DataFrame:
    """(key, idx, y): reads' values with narrow spikes flattened. A read meets in one task, as each change shows in the next."""

    def run(read: pd.DataFrame) -> pd.DataFrame:
        read = read.sort_values(idx)
        return read[[key, idx]].assign(**{y: flatten_spikes(read[x].to_numpy(float), read[y].to_numpy(float), width)})

    types = dict(signal.dtypes)
    return signal.select(key, idx, x, y).groupBy(key).applyInPandas(run, f"{key} {types[key]}, {idx} {types[idx]}, {y} double")


def polyline(signal: DataFrame, key: str, idx: str, x: str, y: str, tolerance: float) -> DataFrame:
    """(key, idx, x, y): the corner points of each read's signal, see corner_points. A read meets in one task."""

    def run(read: pd.DataFrame) -> pd.DataFrame:
        read = read.sort_values(idx)
        return read.iloc[corner_points(read[x].to_numpy(float), read[y].to_numpy(float), tolerance)]

    held = signal.select(key, idx, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))
    return held.groupBy(key).applyInPandas(run, held.schema)


class Corners:
    """Corner points of a read and the tracts they make."""

    def __init__(self, x: np.ndarray, y: np.ndarray, min_jump: float):
        self.x, self.y, self.j, self.last = x, y, min_jump, len(x) - 1
        self.jump = np.diff(y)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.slope = self.jump / np.diff(x) * 1e5

    def _steep(self, sign: int, i: int) -> bool:
        """A jump beyond the least one at i, or two lesser ones that make it together."""
        a, b = sign * self.jump[i], sign * self.jump[i + 1]
        return a > self.j or (a <= self.j and b <= self.j and a + b > self.j)

    def _sides(self, i: int, end: int) -> tuple[float, float]:
        """Slopes from the start to the top, and from there to the end."""
        top = i + int(self.y[i:end].argmax())
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.float64(self.y[top] - self.y[i]) / (self.x[top] - self.x[i]) * 1e5
            down = np.float64(self.y[end] - self.y[top]) / (self.x[end] - self.x[top]) * 1e5
        return up, down

    def _directed(self, i: int, end: int) -> tuple[str, float]:
        up, down = self._sides(i, end)
        rise = self.y[end] - self.y[i]
        right = -1.5 * down < up or (rise > 0.075 and end != self.last)
        left = 1.5 * up < -down or (-rise > 0.075 and i != 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            if right and not left:
                return "R", max(up / -down, 20 * rise)
            if left and not right:
                return "L", min(down / up, 20 * rise)
        return "?", 0.0

    def forward(self) -> tuple[list[Tract], set[int]]:
        """Tracts that open with a rise and close with the first fall far enough below the end of it; and the falls used."""
        tracts: list[Tract] = []
        used: set[int] = set()
        for i in range(self.last - 1):
            if not self._steep(1, i):
                continue
            falls = np.nonzero(self.y[i + 2 :] < self.y[i + 1] - 0.6 * self.j)[0]
            if not len(falls):
                continue
            k = i + 1 + int(falls[0])
            before = self.y[k] - self.y[i + 1]
            if k + 1 < self.last and self.jump[k + 1] < 0 and self.slope[k + 1] < -50:
                k += 1  # a fall in two parts
            used.add(k)
            excess = max(self.jump[i], self.jump[i] + self.jump[i + 1], -self.jump[k] - before) - self.j
            tract = Tract(self.x[i], self.x[k + 1], 10 * excess)
            if tracts and tracts[-1].end == tract.end and tracts[-1].dir == "?":
                tract = replace(tracts.pop(), start=tract.start)
            tract.dir, tract.score = self._directed(i, k + 1)
            tracts.append(tract)
        return tracts, used

    def backward(self, tracts: list[Tract], used: set[int]) -> list[Tract]:
        """Adds tracts that end with a fall not used so far and begin at the last rise far enough below it."""
        for k in range(self.last - 1):
            if k in used or not self._steep(-1, k):
                continue
            rises = np.nonzero(self.y[k] - self.y[:k] > 0.6 * self.j)[0]
            if not len(rises):
                continue
            i = int(rises[-1])
            up, down = self._sides(i, k + 1)
            rise = self.y[k + 1] - self.y[i]
            with np.errstate(divide="ignore", invalid="ignore"):
                score = min(down / up, 0.0 if k + 1 == self.last or i == 0 else 20 * rise)
            excess = max(-self.jump[k], -self.jump[k] - self.jump[k + 1], self.y[k] - self.y[i]) - self.j
            tract = Tract(self.x[i], self.x[k + 1], 10 * excess)
            place, over, fate = _contest(tracts, tract, score)
            if fate == "lost":
                continue
            if fate == "won" and (-rise > 0.075 or 1.5 * up < -down):
                tract.dir, tract.score = "L", score
            tracts[place : place + over] = [tract]
        return tracts


def _against_right(score: float, other: Tract) -> str:
    """A leftward score against a rightward tract: a clear winner by a factor of two, or doubt."""
    if -2 * score <= other.score:
        return "lost"
    return "doubt" if -score < 2 * other.score else "won"


def _contest(tracts: list[Tract], new: Tract, score: float) -> tuple[int, int, str]:
    """Where a new tract goes, how many it takes the place of, and whether it won, lost or is in doubt."""
    fate = "won"
    if not tracts or new.start > tracts[-1].start:
        return len(tracts), 0, fate
    place, over = 0, 0
    for place, other in enumerate(tracts):
        if new.start == other.start:
            if other.dir == "R":
                fate = _against_right(score, other)
            elif other.dir == "?":
                fate = "doubt"
            elif other.score < score:
                fate = "lost"
            return place, 1, fate
        if new.start < other.start:
            if new.end <= other.start:
                return place, 0, fate
            over = 1
            if other.dir == "R":
                fate = _against_right(score, other)
    return place, over, fate


def resolve_overlaps(tracts: list[Tract]) -> list[Tract]:
    """While a tract starts inside another, the one of the smaller score by amount goes (the inner one of equal ones).

    The first tract that lies in another and the first that holds it are decided first. Who goes frees others only, so each tract is looked at once, against all that are left at a time.
    """
    start, end, score = (np.array([getattr(t, c) for t in tracts], float) for c in ("start", "end", "score"))
    score, left = np.abs(score), np.ones(len(tracts), bool)
    for a in range(len(tracts)):
        while left[a]:
            holds = left & (start <= start[a]) & (start[a] < end)
            holds[a] = False
            b = int(holds.argmax())
            if not holds[b]:
                break
            left[b if score[a] > score[b] else a] = False
    return [t for t, stays in zip(tracts, left, strict=True) if stays]


def without_overlaps(tracts: DataFrame, key: str) -> DataFrame:
    """(key, start, end, score): tracts left by resolve_overlaps, taken in order of start, end and score. A read's tracts meet in one task."""

    def run(read: pd.DataFrame) -> pd.DataFrame:
        read = read.sort_values(["start", "end", "score"], ignore_index=True)
        left = resolve_overlaps([Tract(t.start, t.end, i, score=t.score) for i, t in enumerate(read.itertuples(index=False))])
        return read.iloc[[t.jump_score for t in left]]

    columns = [key, "start", "end", "score"]
    return tracts.select(*columns).groupBy(key).applyInPandas(run, tracts.select(*columns).schema)


def detect_tracts(x: np.ndarray, y: np.ndarray, min_jump: float) -> list[Tract]:
    """Tracts of the corner points, in order, without overlaps."""
    if len(x) < 3:
        return []
    c = Corners(x, y, min_jump)
    return resolve_overlaps(c.backward(*c.forward()))


def _faces(sure: Tract, other: Tract, way: str, s: Settings, loose: bool) -> bool:
    """sure runs its way with confidence, and other runs the opposite way or could."""
    sign = -1 if way == "L" else 1
    if sure.dir != way or sign * sure.score <= s.score:
        return False
    opposite = "R" if way == "L" else "L"
    strong = abs(sure.jump_score) > s.jump_score and abs(other.jump_score) > s.jump_score
    return other.dir == opposite or (strong and (loose or abs(other.score) < s.score))


def _pairs(tracts: list[Tract], first: str, second: str, s: Settings):
    """Neighbours of which one runs its way for certain. Of a certain R the other's score does not matter, unless mirror is set."""
    for a, b in pairwise(tracts):
        if min(abs(a.jump_score), abs(b.jump_score)) <= s.jump_score / 3:
            continue
        if _faces(a, b, first, s, first == "R" and not s.mirror) or _faces(b, a, second, s, second == "R" and not s.mirror):
            yield a, b


def _closest(x: np.ndarray, at: float) -> int:
    return int(np.abs(x - at).argmin())


def detect_inits(tracts: list[Tract], x: np.ndarray, yr: np.ndarray, s: Settings) -> list[tuple]:
    """(mid, s1, e1, s2, e2) between tracts that diverge over a low plateau; doubtful partners get their direction."""
    out = []
    for a, b in _pairs(tracts, "L", "R", s):
        lo, hi = sorted((_closest(x, a.end), _closest(x, b.start)))
        # added in order, as in SQL: mean() adds in parts, which may differ in the last bit
        if hi == lo or np.cumsum(yr[lo:hi])[-1] / (hi - lo) >= s.low_plateau or b.start - a.end <= s.min_distance:
            continue
        out.append(((a.end + b.start) / 2, a.start, a.end, b.start, b.end))
        for tract, way in ((a, "L"), (b, "R")):
            if tract.dir != way:
                tract.dir, tract.score, tract.jump_score = way, 5.0, 5.0
    return out


def detect_terms(tracts: list[Tract], x: np.ndarray, yr: np.ndarray, s: Settings) -> list[tuple]:
    """(mid, s1, e1, s2, e2) of tracts that converge, low at both outer ends or shortly beyond them."""

    def low(at: float, beyond: float) -> bool:
        return min(yr[_closest(x, at)], yr[_closest(x, beyond)]) < s.low_plateau

    return [
        ((a.start + b.end) / 2, a.start, a.end, b.start, b.end)
        for a, b in _pairs(tracts, "R", "L", s)
        if low(a.start, a.start - s.flank) and low(b.end, b.end + s.flank)
    ]


def analyse_read(x: np.ndarray, yr: np.ndarray, s: Settings) -> list[dict]:
    """Rows of kind tract, init and term of one read."""
    at = corner_points(x, yr, s.tolerance)
    cx, cy = x[at], yr[at]
    order = np.argsort(cx, kind="stable")
    cx, cy = cx[order], cy[order]
    tracts = detect_tracts(cx, flatten_spikes(cx, cy, s.spike), s.min_jump)
    inits = detect_inits(tracts, x, yr, s)
    rows = [{"kind": "tract", "id": i, **vars(t)} for i, t in enumerate(tracts)]
    for kind, found in (("init", inits), ("term", detect_terms(tracts, x, yr, s))):
        rows += [{"kind": kind, "id": i, **dict(zip(("mid", "s1", "e1", "s2", "e2"), v, strict=True))} for i, v in enumerate(found)]
    return rows


FIELDS = {"kind": "string", "id": "int", "start": "double", "end": "double", "dir": "string", "score": "double", "jump_score": "double"} | {c: "double" for c in ("mid", "s1", "e1", "s2", "e2")}


def detect_tracks_of(signal: DataFrame, key: str, idx: str, x: str, tracks: dict[str, tuple[str, Settings]]) -> DataFrame:
    """Rows of detect_forks() for each track name: (y, settings) of the reads' signals (key, idx, x, y...), with the track's name.

    Positions without a value of a track are left out of it. A read's scaled signals meet in one task, all tracks at once; reads are of bounded length.
    """
    scaled = _scaled(signal, key, idx, {f"__yr_{name}": t for name, t in tracks.items()})
    held = [f"__yr_{name}" for name in tracks]
    scaled = scaled.filter(F.coalesce(*held).isNotNull()).select(key, idx, x, *held)

    def rows_of(reads: pd.DataFrame) -> pd.DataFrame:
        """Rows of whole reads, each in one stretch and in order."""
        places, values = reads[x].to_numpy(float), {name: reads[f"__yr_{name}"].to_numpy(float) for name in tracks}
        rows = []
        for start, end in pairwise(_stretches(reads[key])):
            read = reads[key].iloc[start]
            for name, (_, settings) in tracks.items():
                part = start + np.nonzero(~np.isnan(values[name][start:end]))[0]
                if len(part):
                    rows += [{key: read, "track": name, **r} for r in analyse_read(places[part], values[name][part], settings)]
        return pd.DataFrame(rows, columns=[key, "track", *FIELDS])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            # the last read may go on in the next batch
            last = _stretches(held[key])[-2]
            if last:
                yield rows_of(held.iloc[:last])
                held = held.iloc[last:].reset_index(drop=True)
        if held is not None:
            yield rows_of(held)

    kind = dict(signal.dtypes)[key]
    schema = f"{key} {kind}, track string, " + ", ".join(f"`{c}` {t}" for c, t in FIELDS.items())
    # windows have brought a read's rows together already; rows of many reads leave a task at a time
    return scaled.sortWithinPartitions(key, idx).mapInPandas(run, schema)


def _stretches(keys: pd.Series) -> list[int]:
    """Where stretches of equal keys begin, nulls being equal, and the end."""
    codes = pd.factorize(keys, use_na_sentinel=False)[0]
    return [0, *(np.nonzero(np.diff(codes))[0] + 1).tolist(), len(codes)]


def detect_forks(signal: DataFrame, key: str, idx: str, x: str, y: str, settings: Settings = LETTERS) -> DataFrame:
    """Tracts, initiations and terminations of reads' signals (key, idx, x: place on the genome, y), a row each (see FIELDS)."""
    return detect_tracks_of(signal, key, idx, x, {"one": (y, settings)}).drop("track")
