"""Elastic-net regression tuned from sums: one pass over the rows for all settings and folds.

A linear model on one-hot blocks and a year needs nothing of the rows but sums of products of
its columns. They are counted per fold by plain grouping: each row names the pairs of slots
that it fills, and partial aggregation leaves a few numbers for each pair of labels. Sums of all
folds but one train a setting, those of the one measure it, so nine settings and three folds
cost one scan in place of twenty-seven. The matrices have one row for each label; ``WIDEST``
bounds them.

The objective is that of Spark's ``LinearRegression``: half the mean squared error plus
``regParam * ((1 - elasticNetParam) / 2 * L2 + elasticNetParam * L1)`` on columns and label
scaled to unit population deviation, the intercept free of penalty, constant columns at zero.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Estimator
from pyspark.ml.feature import StringIndexerModel
from pyspark.ml.param import Param
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countcast.spec import CountSpec

#: Columns of the widest model whose sums are taken; wider ones are fitted fold by fold.
WIDEST = 1024
#: Settings that the sums know; with any other, a model is fitted fold by fold.
KNOWN = {"regParam", "elasticNetParam", "fitIntercept"}
#: Coordinate descent ends when no scaled coefficient moves by more, or after so many sweeps;
#: then the exact optimum is sought from where it stands.
STILL, SWEEPS = 1e-11, 200


def width(indexer: StringIndexerModel | None, spec: CountSpec) -> int:
    """Columns of the one-hot blocks and the year."""
    return sum(map(len, indexer.labelsArray if indexer else [])) + (spec.year_dim is not None)


def tunable(estimator: Estimator, grid: Sequence[Mapping[Param, object]], columns: int) -> bool:
    """Whether errors of these settings follow from sums of products."""
    if not isinstance(estimator, LinearRegression) or columns > WIDEST:
        return False
    plain = estimator.getLoss() == "squaredError" and estimator.getStandardization() and not estimator.isSet("weightCol")
    return plain and all(p.name in KNOWN for settings in grid for p in settings)


def fold_sums(indexed: DataFrame, indexer: StringIndexerModel | None, spec: CountSpec, label: str = "label") -> DataFrame:
    """``(fold, i, j, rows, label, label2, year, year2, year_label)`` of rows with category indexes.

    Row (i, j) holds the sums over the rows whose one-hot slots i < j are both set, (i, i) those over
    the rows with slot i, and (-1, -1) those over all. A slot of an unseen label is none.
    """
    slots: list[Column] = [F.lit(-1)]
    before = 0
    for dim, labels in zip(spec.dims, indexer.labelsArray if indexer else []):
        index = F.col(f"{dim}_idx").cast("int")
        slots.append(F.when(index < len(labels), index + before))
        before += len(labels)
    year = F.lit(0.0) if spec.year_dim is None else F.col("numeric_year")
    own = [F.struct(s.alias("i"), s.alias("j"), F.lit(True).alias("whole")) for s in slots]
    pairs = [
        F.struct(a.alias("i"), b.alias("j"), F.lit(False).alias("whole"))
        for k, a in enumerate(slots[1:], 1)
        for b in slots[k + 1 :]
    ]
    named = indexed.select("fold", F.col(label).alias("y"), year.alias("t"), F.inline(F.array(*own, *pairs)))
    y, t = F.when(F.col("whole"), F.col("y")), F.when(F.col("whole"), F.col("t"))
    return named.where("i is not null and j is not null").groupBy("fold", "i", "j").agg(
        F.count("*").alias("rows"), F.sum(y).alias("label"), F.sum(y * y).alias("label2"),
        F.sum(t).alias("year"), F.sum(t * t).alias("year2"), F.sum(t * y).alias("year_label"),
    )


@dataclass
class Sums:
    """Sums of products over some rows: of the columns, with the label, and of the label."""

    rows: float
    x: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    y: float
    yy: float

    @classmethod
    def empty(cls, columns: int) -> Sums:
        return cls(0.0, np.zeros(columns), np.zeros((columns, columns)), np.zeros(columns), 0.0, 0.0)

    def __add__(self, other: Sums) -> Sums:
        return Sums(*(a + b for a, b in zip(vars(self).values(), vars(other).values())))

    def mean_squared_error(self, coefficients: np.ndarray, intercept: float) -> float:
        b = coefficients
        explained = b @ self.xx @ b + 2 * intercept * (b @ self.x) + self.rows * intercept**2
        return max(0.0, self.yy - 2 * (b @ self.xy + intercept * self.y) + explained) / self.rows


def gathered(sums: DataFrame, columns: int, with_year: bool) -> dict[int, Sums]:
    """The sums of each fold as matrices: a row for each pair of labels comes to the driver."""
    out: dict[int, Sums] = {}
    last = columns - 1  # the year's column, if there is one
    table = sums.toPandas()
    for fold, part in table.groupby("fold"):
        s = out[int(fold)] = Sums.empty(columns)
        i, j = part["i"].to_numpy(), part["j"].to_numpy()
        both = (i >= 0) & (i != j)
        s.xx[i[both], j[both]] = s.xx[j[both], i[both]] = part["rows"].to_numpy()[both]
        own = part[(i == j) & (i >= 0)]
        at = own["i"].to_numpy()
        s.x[at] = s.xx[at, at] = own["rows"]
        s.xy[at] = own["label"]
        every = part[i < 0].iloc[0]
        s.rows, s.y, s.yy = float(every["rows"]), every["label"], every["label2"]
        if with_year:
            s.xx[at, last] = s.xx[last, at] = own["year"]
            s.x[last], s.xx[last, last], s.xy[last] = every["year"], every["year2"], every["year_label"]
    return out


@dataclass
class _Scaled:
    """The quadratic of one fit on columns and label of unit deviation."""

    matrix: np.ndarray
    target: np.ndarray
    scale: np.ndarray  # deviation of each column, 0 where it is constant
    label_scale: float
    sums: Sums
    intercept: bool

    @classmethod
    def of(cls, s: Sums, intercept: bool) -> _Scaled:
        mean, label_mean = s.x / s.rows, s.y / s.rows
        variance = np.maximum(0.0, np.diag(s.xx) / s.rows - mean**2)
        variance[variance <= 1e-12 * np.maximum(1.0, mean**2)] = 0.0
        scale = np.sqrt(variance)
        label_scale = np.sqrt(max(0.0, s.yy / s.rows - label_mean**2))
        if not label_scale:
            label_scale = 0.0 if intercept else abs(label_mean)
        shift = (mean, label_mean) if intercept else (0 * mean, 0.0)
        inverse = np.divide(1.0, scale, out=np.zeros_like(scale), where=scale > 0)
        matrix = (s.xx / s.rows - np.outer(shift[0], shift[0])) * np.outer(inverse, inverse)
        target = (s.xy / s.rows - shift[0] * shift[1]) * inverse / (label_scale or 1.0)
        return cls(matrix, target, scale, float(label_scale), s, intercept)

    def unscaled(self, beta: np.ndarray) -> tuple[np.ndarray, float]:
        """(coefficients, intercept) on the original columns."""
        inverse = np.divide(1.0, self.scale, out=np.zeros_like(self.scale), where=self.scale > 0)
        coefficients = beta * inverse * self.label_scale
        s = self.sums
        return coefficients, float((s.y - coefficients @ s.x) / s.rows) if self.intercept else 0.0


@dataclass(frozen=True)
class Setting:
    reg: float
    mix: float
    intercept: bool = True


def _descend(problems: Sequence[_Scaled], settings: Sequence[Setting]) -> np.ndarray:
    """Coordinate descent on all problems side by side: a row of scaled coefficients for each."""
    columns = len(problems[0].target)
    matrices = np.stack([p.matrix for p in problems])
    diagonal = np.einsum("pjj->pj", matrices)
    labels = np.array([p.label_scale or np.inf for p in problems])
    l1 = np.array([s.reg * s.mix for s in settings]) / labels
    l2 = np.array([s.reg * (1 - s.mix) for s in settings]) / labels
    beta = np.zeros((len(problems), columns))
    left = np.stack([p.target for p in problems])  # target - matrix @ beta
    active = np.arange(len(problems))
    for _ in range(SWEEPS):
        moved = np.zeros(len(active))
        m, b, r, d, a1, a2 = matrices[active], beta[active], left[active], diagonal[active], l1[active], l2[active]
        for j in range(columns):
            pull = r[:, j] + d[:, j] * b[:, j]
            weight = d[:, j] + a2
            new = np.sign(pull) * np.maximum(np.abs(pull) - a1, 0) / np.where(weight > 0, weight, 1.0)
            step = np.where(d[:, j] > 0, new, 0.0) - b[:, j]
            b[:, j] += step
            r -= step[:, None] * m[:, j]
            np.maximum(moved, np.abs(step), out=moved)
        beta[active], left[active] = b, r
        active = active[moved > STILL]
        if not len(active):
            break
    for k in active:
        beta[k] = _finished(matrices[k], problems[k].target, l1[k], l2[k], beta[k])
    return beta


def _finished(matrix: np.ndarray, target: np.ndarray, l1: float, l2: float, beta: np.ndarray) -> np.ndarray:
    """The optimum, by steps between supports that each lower the objective.

    On a support with given signs the objective is a quadratic. Its optimum is taken if it keeps
    the signs, else the way to it is followed until the first coefficient becomes zero and
    leaves; along a direction in which the quadratic is flat (collinear columns) the L1 part
    decides. At the optimum of a support, the column with the steepest gradient beyond the
    penalty joins. Columns that nearly repeat each other make plain descent very slow here.
    """
    beta = beta.copy()
    sign = np.sign(beta)
    for _ in range(20 * len(beta) + 100):
        use = np.flatnonzero(sign)
        if len(use):
            inner = matrix[np.ix_(use, use)] + l2 * np.eye(len(use))
            values, vectors = np.linalg.eigh(inner)
            if not l2 and values[0] <= 1e-10 * max(1.0, values[-1]):
                way = vectors[:, 0] * (-1.0 if sign[use] @ vectors[:, 0] > 0 else 1.0)
                far = np.inf
            else:
                way = np.linalg.solve(inner, target[use] - l1 * sign[use]) - beta[use]
                far = 1.0
            against = np.flatnonzero(way * sign[use] < 0)
            reach = -beta[use][against] / way[against]
            if len(against) and reach.min() < far:
                first = against[reach.argmin()]
                beta[use] += reach.min() * way
                beta[use[first]] = sign[use[first]] = 0.0
                continue
            if np.isinf(far):
                break
            beta[use] += way
        pull = target - matrix @ beta
        pull[use] = 0.0
        steepest = int(np.abs(pull).argmax())
        if np.abs(pull[steepest]) <= l1 * (1 + 1e-9) + 1e-13:
            break
        sign[steepest] = np.sign(pull[steepest])
    return beta


def solve(problems: Sequence[tuple[Sums, Setting]]) -> list[tuple[np.ndarray, float]]:
    """(coefficients, intercept) of each problem: ridge directly, those with an L1 part by descent."""
    scaled = [_Scaled.of(s, setting.intercept) for s, setting in problems]
    found: list[np.ndarray | None] = []
    for p, (_, setting) in zip(scaled, problems):
        if setting.reg * setting.mix or not p.label_scale:
            found.append(None if p.label_scale else np.zeros_like(p.target))
            continue
        use = p.scale > 0
        beta = np.zeros_like(p.target)
        ridge = p.matrix[np.ix_(use, use)] + setting.reg / p.label_scale * np.eye(int(use.sum()))
        beta[use] = np.linalg.lstsq(ridge, p.target[use], rcond=1e-12)[0]
        found.append(beta)
    rest = [k for k, beta in enumerate(found) if beta is None]
    if rest:
        for k, beta in zip(rest, _descend([scaled[k] for k in rest], [problems[k][1] for k in rest])):
            found[k] = beta
    return [p.unscaled(beta) for p, beta in zip(scaled, found)]


def fold_errors(folds: Mapping[int, Sums], settings: Sequence[Setting]) -> list[list[float]]:
    """Root mean squared error of every setting on every fold, fitted on the other folds.

    A fold without rows, or without rows outside it, measures nothing and is left out.
    """
    held = [k for k, s in sorted(folds.items()) if s.rows and any(o.rows for j, o in folds.items() if j != k)]
    rest = {k: sum((s for j, s in folds.items() if j != k), Sums.empty(len(folds[k].x))) for k in held}
    fits = iter(solve([(rest[k], setting) for setting in settings for k in held]))
    return [[float(np.sqrt(folds[k].mean_squared_error(*next(fits)))) for k in held] for _ in settings]


def settings_of(estimator: LinearRegression, grid: Sequence[Mapping[Param, object]]) -> list[Setting]:
    out = []
    for chosen in grid:
        value = {p.name: v for p, v in chosen.items()}
        out.append(
            Setting(
                float(value.get("regParam", estimator.getRegParam())),
                float(value.get("elasticNetParam", estimator.getElasticNetParam())),
                bool(value.get("fitIntercept", estimator.getFitIntercept())),
            )
        )
    return out


def tune_errors(indexed: DataFrame, indexer: StringIndexerModel | None, spec: CountSpec, estimator: LinearRegression, grid: Sequence[Mapping[Param, object]]) -> list[float]:
    """Mean fold error of each setting, from one pass over rows with category indexes and folds."""
    with_year = spec.year_dim is not None
    folds = gathered(fold_sums(indexed, indexer, spec), width(indexer, spec), with_year)
    return [float(np.mean(e)) if e else float("nan") for e in fold_errors(folds, settings_of(estimator, grid))]
