"""Generalised linear models with cluster-robust errors (STA-02 to STA-06).

The models have few predictors, so each step needs only small sums over all rows: every partition adds up
its own in one matrix product for all models and strata at once, and the driver solves systems of
that size. Covariances are sandwiches of the sums of each cluster's scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators import summarise


@dataclass(frozen=True)
class Model:
    """family: binomial, poisson, gamma or gaussian (logit, log, log, identity link); offset: a column on the link's scale.

    log1p: the outcome is ln(1 + y). least_rows: rows below which nothing is fitted; both: a predictor that must have two values."""

    family: str
    outcome: str
    predictors: tuple[str, ...]
    cluster: str
    offset: str | None = None
    log1p: bool = False
    steps: int = 100
    tolerance: float = 1e-8
    least_rows: int = 1
    both: str | None = None


def _mean(family: str, eta: np.ndarray) -> np.ndarray:
    return {"binomial": lambda: 1 / (1 + np.exp(-eta)), "gaussian": lambda: eta}.get(family, lambda: np.exp(eta))()


def _parts(family: str, mu: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight, score factor and deviance of each row."""
    one = np.ones_like(mu)
    if family == "binomial":
        return mu * (1 - mu), y - mu, -2 * np.log(np.where(y > 0.5, mu, 1 - mu))
    if family == "poisson":
        return mu, y - mu, 2 * (np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0) - (y - mu))
    if family == "gamma":
        return one, (y - mu) / mu, 2 * (-np.log(y / mu) + (y - mu) / mu)
    return one, y - mu, (y - mu) ** 2


@dataclass(frozen=True)
class _Spec:
    """One model in one stratum, by the names of the prepared columns."""

    model: Model
    stratum: str

    def rows(self, batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Predictors, outcome and offset of the complete rows, and which rows these are."""
        m = self.model
        x = np.column_stack([np.ones(len(batch)), *[batch[p].to_numpy(dtype=float) for p in m.predictors]])
        y = batch[m.outcome].to_numpy(dtype=float)
        o = batch[m.offset].to_numpy(dtype=float) if m.offset else np.zeros(len(batch))
        if m.log1p:
            y = np.log1p(np.where(y >= 0, y, np.nan))
        valid = np.isfinite(x).all(axis=1) & np.isfinite(y) & np.isfinite(o) & batch[self.stratum].to_numpy(dtype=bool) & batch[f"_g_{m.cluster}"].notna().to_numpy()
        if m.family == "gamma":
            valid &= np.nan_to_num(y) > 0
        return x[valid], y[valid], o[valid], valid


def _sums(rows: DataFrame, work) -> dict[int, dict[int, tuple[float, float, float]]]:
    """By fit and place the sum, least and largest value of what `work` yields for each batch: (fit, values)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for fit, values in work(batch):
                sums, low, high = told.setdefault(fit, [np.zeros(len(values)), np.full(len(values), np.inf), np.full(len(values), -np.inf)])
                sums += values
                np.minimum(low, values, out=low)
                np.maximum(high, values, out=high)
        for fit, (sums, low, high) in told.items():
            yield pd.DataFrame({"fit": fit, "at": np.arange(len(sums)), "value": sums, "low": low, "high": high})

    out: dict[int, dict[int, tuple[float, float, float]]] = {}
    found = rows.mapInPandas(run, "fit int, at int, value double, low double, high double").groupBy("fit", "at")
    for r in found.agg(F.sum("value").alias("v"), F.min("low").alias("l"), F.max("high").alias("h")).collect():  # a few for each model
        out.setdefault(r["fit"], {})[r["at"]] = (r["v"], r["l"], r["h"])
    return out


def _beginnings(rows: DataFrame, specs: list[_Spec]) -> list[tuple]:
    """Number of complete rows, mean, and ranges of outcome and of the predictor that must vary, for each fit."""

    def work(batch: pd.DataFrame):
        for i, spec in enumerate(specs):
            x, y, _, _ = spec.rows(batch)
            if len(y):
                b = x[:, 1 + spec.model.predictors.index(spec.model.both)] if spec.model.both else y
                yield i, np.array([len(y), y.sum()])
                yield len(specs) + i, np.array([y.min(), b.min()])
                yield 2 * len(specs) + i, np.array([y.max(), b.max()])

    told, size, out = _sums(rows, work), len(specs), []
    for i in range(size):
        n, total = (told[i][0][0], told[i][1][0]) if i in told else (0, 0.0)
        low, high = (told[size + i], told[2 * size + i]) if n else ({0: (0, 0, 0), 1: (0, 0, 0)},) * 2
        out.append((int(n), total / n if n else 0.0, low[0][1] == high[0][2], low[1][1] == high[1][2]))
    return out


def fit_strata(df: DataFrame, models: dict[str, Model], strata: dict[str, str]) -> dict[tuple[str, str], list[dict]]:
    """By stratum and model a row for each term: estimate, robust error, p value, ratio and its 95 % interval, status, rows and clusters.

    Rows incomplete in any column don't count; for gamma neither do outcomes of 0 or less. status is
    fit_converged, fit_warning (no convergence), fit_failed (singular), not_fit_no_complete_rows,
    not_fit_too_few_rows, not_fit_one_group or not_fit_outcome_has_one_class; without a fit all numbers
    are null. A step reads the rows once for all that are still being fitted. Ratios are those of logit and log
    links and of the logarithm of an outcome.
    """
    names = sorted({c for m in models.values() for c in (m.outcome, *m.predictors, *([m.offset] if m.offset else []))})
    clusters = sorted({m.cluster for m in models.values()})
    flags = {stratum: f"_s{i}" for i, stratum in enumerate(strata)}
    rows = df.select(
        *[F.col(c).cast("double").alias(c) for c in names], *[F.col(c).cast("string").alias(f"_g_{c}") for c in clusters],
        *[F.coalesce(F.expr(condition), F.lit(False)).alias(flags[stratum]) for stratum, condition in strata.items()],
    ).persist()
    keys = [(stratum, name) for stratum in strata for name in models]
    specs = [_Spec(models[name], flags[stratum]) for stratum, name in keys]
    size = [1 + len(s.model.predictors) for s in specs]
    status, beta, last = [""] * len(specs), [np.zeros(k) for k in size], [math.nan] * len(specs)
    begun = _beginnings(rows, specs)
    for i, (spec, (n, mean, one_class, one_group)) in enumerate(zip(specs, begun)):
        m = spec.model
        if not n:
            status[i] = "not_fit_no_complete_rows"
        elif n < m.least_rows:
            status[i] = "not_fit_too_few_rows"
        elif m.both and one_group:
            status[i] = "not_fit_one_group"
        elif m.family == "binomial" and one_class:
            status[i] = "not_fit_outcome_has_one_class"
        elif m.family == "binomial":
            beta[i][0] = math.log(mean / (1 - mean))
        else:
            beta[i][0] = mean if m.family == "gaussian" else math.log(mean) if mean > 0 else 0.0

    def information(active: list[int]) -> dict:
        """Products of the predictors, of predictors and scores, and the deviance, at the present estimates."""
        now = {i: beta[i].copy() for i in active}

        def work(batch: pd.DataFrame):
            for i, b in now.items():
                x, y, o, _ = specs[i].rows(batch)
                if len(y):
                    with np.errstate(all="ignore"):
                        mu = _mean(specs[i].model.family, x @ b + o)
                        w, factor, loss = _parts(specs[i].model.family, mu, y)
                        yield i, np.concatenate([((x * w[:, None]).T @ x).ravel(), x.T @ factor, [loss.sum()]])

        return {i: np.array([told[at][0] for at in range(len(told))], dtype=float) for i, told in _sums(rows, work).items()}

    for step in range(max(m.steps for m in models.values())):
        active = [i for i, spec in enumerate(specs) if not status[i] and step < spec.model.steps]
        if not active:
            break
        for i, told in information(active).items():
            k = size[i]
            try:
                move = np.linalg.solve(told[: k * k].reshape(k, k), told[k * k : -1])
                if not (np.isfinite(move).all() and math.isfinite(told[-1])):
                    raise np.linalg.LinAlgError
            except np.linalg.LinAlgError:
                status[i] = "fit_failed"
                continue
            tolerance = specs[i].model.tolerance
            if abs(told[-1] - last[i]) <= tolerance * (abs(last[i]) + 0.1) and np.abs(move).max() <= math.sqrt(tolerance) * (1 + np.abs(beta[i]).max()):
                status[i] = "fit_converged"
            beta[i], last[i] = beta[i] + move, told[-1]
    status = [s or "fit_warning" for s in status]
    fitted = [i for i, s in enumerate(status) if s in ("fit_converged", "fit_warning")]
    bread = information(fitted) if fitted else {}
    groups, meat = _clusters(rows, specs, beta)
    rows.unpersist()
    out = {}
    for i, key in enumerate(keys):
        errors = None
        if i in fitted:
            errors = _errors(bread[i], meat.get(i), groups.get(i, 0), begun[i][0], size[i])
            if errors is None:
                status[i] = "fit_failed"
        out[key] = _told(specs[i].model, beta[i], errors, begun[i][0], groups.get(i, 0), status[i])
    return out


def _clusters(rows: DataFrame, specs: list[_Spec], beta: list[np.ndarray]) -> tuple[dict[int, int], dict[int, np.ndarray]]:
    """Number of clusters and the summed products of the clusters' scores, for each fit."""
    width = max(len(b) for b in beta)
    names = [f"u{j}" for j in range(width)]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, spec in enumerate(specs):
                x, y, o, valid = spec.rows(batch)
                if not len(y):
                    continue
                with np.errstate(all="ignore"):
                    _, factor, _ = _parts(spec.model.family, _mean(spec.model.family, x @ beta[i] + o), y)
                u = np.zeros((len(y), width))
                u[:, : x.shape[1]] = x * factor[:, None]
                frame = pd.DataFrame(u, columns=names).assign(g=batch.loc[valid, f"_g_{spec.model.cluster}"].to_numpy())
                yield frame.groupby("g", as_index=False).sum().assign(fit=i)[["fit", "g", *names]]

    found = rows.mapInPandas(score, "fit int, g string, " + ", ".join(f"{n} double" for n in names)).groupBy("fit", "g").agg(*[F.sum(n).alias(n) for n in names])
    products = [F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a in names for b in names]
    groups, meat = {}, {}
    for r in found.groupBy("fit").agg(F.count("*").alias("n"), *products).collect():
        k = len(beta[r["fit"]])
        groups[r["fit"]] = r["n"]
        meat[r["fit"]] = np.array([[r[f"u{a}_u{b}"] for b in range(k)] for a in range(k)], dtype=float)
    return groups, meat


def _errors(bread: np.ndarray, meat: np.ndarray | None, groups: int, n: int, k: int) -> np.ndarray | None:
    """Cluster-robust errors with the correction for few clusters; None if they can't be told."""
    try:
        inverse = np.linalg.inv(bread[: k * k].reshape(k, k))
        correction = groups / (groups - 1) * (n - 1) / (n - k) if groups > 1 and n > k else 1.0
        square = np.diag(inverse @ meat @ inverse) * correction
        return np.sqrt(square) if np.isfinite(square).all() and (square >= 0).all() else None
    except (np.linalg.LinAlgError, TypeError, ValueError):
        return None


def _told(model: Model, beta: np.ndarray, errors: np.ndarray | None, n: int, groups: int, status: str) -> list[dict]:
    out = []
    for i, term in enumerate(["intercept", *model.predictors]):
        row = {"term": term, "estimate": None, "error": None, "p_value": None, "ratio": None, "ratio_low": None, "ratio_high": None}
        if errors is not None:
            b, e = float(beta[i]), float(errors[i])
            row |= {"estimate": b, "error": e, "p_value": math.erfc(abs(b / e) / math.sqrt(2)) if e > 0 else None}
            if (model.family != "gaussian" or model.log1p) and abs(b) + 2 * e < 700:
                row |= {"ratio": math.exp(b), "ratio_low": math.exp(b - 1.959963984540054 * e), "ratio_high": math.exp(b + 1.959963984540054 * e)}
        out.append(row | {"n_rows": n, "n_clusters": groups, "status": status})
    return out


def fit(df: DataFrame, model: Model) -> list[dict]:
    """The rows of fit_strata for a single model over all rows."""
    return fit_strata(df, {"": model}, {"": "true"})["", ""]


SCHEMA = (
    "model string, stratum string, term string, estimate double, error double, p_value double, ratio double, ratio_low double, ratio_high double, "
    "n_rows long, n_clusters long, status string"
)


def fit_grid(df: DataFrame, models: dict[str, Model], strata: dict[str, str] | None = None) -> DataFrame:
    """STA-06: the terms of every model on all rows (`overall`) and in each stratum (name and condition)."""
    found = fit_strata(df, models, {"overall": "true", **(strata or {})})
    rows = [{"model": name, "stratum": stratum, **row} for (stratum, name), own in found.items() for row in own]
    order = [c.split()[0] for c in SCHEMA.split(", ")]
    return df.sparkSession.createDataFrame([tuple(r[c] for c in order) for r in rows], SCHEMA)


#: Adjustment sets, each an extension of the one before, and the families of counts and stays (STA-06).
ADJUSTMENTS = {
    "cohort_only": ("exposed",),
    "age_elixhauser": ("exposed", "age10", "score5"),
    "age_elixhauser_prior365": ("exposed", "age10", "score5", "log_prior"),
}


def adjustment_grid(counts: list[str], stays: list[str], cluster: str, adjustments: dict[str, tuple[str, ...]] = ADJUSTMENTS) -> dict[str, Model]:
    """STA-06: `<outcome>|<family>|<adjustment>` of Poisson models of counts, and log-linear and gamma models of stays, in each adjustment."""
    out = {}
    for name, predictors in adjustments.items():
        out |= {f"{y}|poisson_log|{name}": Model("poisson", y, predictors, cluster) for y in counts}
        for y in stays:
            out[f"{y}|log_ols|{name}"] = Model("gaussian", y, predictors, cluster, log1p=True)
            out[f"{y}|gamma_log|{name}"] = Model("gamma", y, predictors, cluster)
    return out


def side_by_side(results: DataFrame, term: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """RSH-04: stratum, outcome and one term's ratio and p value for every (family, adjustment) pair."""
    own = results.where(F.col("term") == term)
    parts = [F.split("model", r"\|")[i].alias(n) for i, n in enumerate(("outcome", "family", "adjustment"))]
    own = own.select("stratum", *parts, "ratio", "p_value")
    wide = [summarise.two_key_pivot(own, ["stratum", "outcome"], "family", "adjustment", pairs, value) for value in ("ratio", "p_value")]
    return wide[0].join(wide[1], ["stratum", "outcome"])
