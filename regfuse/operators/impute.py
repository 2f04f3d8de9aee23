"""Filling missing numeric and categorical values: same plant first, then a mixed Gaussian-categorical mixture.

The mixture has one component for each cell of the categorical fields (country by fuel): a multinomial over cells
and, in a cell, a Gaussian with the cell's mean and a covariance pooled over cells and shrunk to them. Expectation-
maximisation handles values missing in either kind of field:

* rows whose cell is observed enter the E-step only through sums of their observed values and of the products of
  these, per cell and pattern of missing numbers. One pass over the data gathers those sums; every later iteration
  of EM runs on them, exactly, without another pass.
* rows with an unknown category have responsibilities over the cells they may belong to; they are the small rest
  that each iteration passes over, in Arrow batches, returning summed statistics only.

Cells are bounded by ``max_categories``; rarer categories share one. Filled numbers are conditional expectations
given all observed fields, filled categories the mode of the cell's distribution, and masks mark every fill.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regfuse.session import Cut

OTHER = "\x00other"
MAX_CATEGORIES = 48
ITERATIONS, TOLERANCE = 12, 1e-4
#: Weight, in rows, of the parent's mean in a cell's mean, and of the pooled covariance in a cell's own.
SHRINK_MEAN, SHRINK_COV = 2.0, 20.0


class Mixture:
    """Fitted parameters. ``levels[j]`` are the categories of field j; cells are numbered in row-major order."""

    def __init__(self, numeric: list[str], categorical: list[str], levels: list[list[str]]):
        self.numeric, self.categorical, self.levels = numeric, categorical, levels
        self.shape = tuple(len(x) for x in levels)
        self.cells = int(np.prod(self.shape))
        self.d = len(numeric)
        self.iterations = 0

    def start(self, centre: np.ndarray, cov: np.ndarray) -> None:
        self.pi = np.full(self.cells, 1.0 / self.cells)
        self.mean = np.tile(centre, (self.cells, 1))
        self.cov = np.tile(cov, (self.cells, 1, 1))

    def conditional(self, pattern: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For numbers observed by the bits of ``pattern``, of all cells: (observed, missing, regressions, rest covariances)."""
        o = np.array([j for j in range(self.d) if pattern >> j & 1], dtype=int)
        m = np.array([j for j in range(self.d) if not pattern >> j & 1], dtype=int)
        s = self.cov
        if not len(o):
            return o, m, np.zeros((self.cells, len(m), 0)), s[:, m][:, :, m]
        som = s[:, o][:, :, m]
        b = np.linalg.solve(s[:, o][:, :, o], som).transpose(0, 2, 1)
        return o, m, b, s[:, m][:, :, m] - b @ som

    def expected(self, cell: np.ndarray, pattern: int, n: np.ndarray, sx: np.ndarray, sxx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of E[x] and E[xx'] for groups of rows of one pattern, from the sums of their observed values.

        ``cell`` numbers the groups' cells, ``n`` their rows, ``sx`` and ``sxx`` their sums."""
        o, m, b, rest = self.conditional(pattern)
        b, rest, mu = b[cell], rest[cell], self.mean[cell]
        a = mu[:, m] - np.einsum("gmo,go->gm", b, mu[:, o])
        so, soo = sx[:, o], sxx[:, o][:, :, o]
        bso = np.einsum("gmo,go->gm", b, so)
        ex, exx = np.zeros((len(cell), self.d)), np.zeros((len(cell), self.d, self.d))
        ex[:, o], ex[:, m] = so, n[:, None] * a + bso
        mo = a[:, :, None] * so[:, None, :] + b @ soo
        mm = n[:, None, None] * (rest + a[:, :, None] * a[:, None, :]) + a[:, :, None] * bso[:, None, :] + bso[:, :, None] * a[:, None, :] + b @ soo @ b.transpose(0, 2, 1)
        for x, i in enumerate(o):
            exx[:, i, o] = soo[:, x]
        for x, i in enumerate(m):
            exx[:, i, o], exx[:, o, i], exx[:, i, m] = mo[:, x], mo[:, x], mm[:, x]
        return ex, exx

    def maximise(self, n: np.ndarray, ex: np.ndarray, exx: np.ndarray) -> float:
        """The M-step with shrinkage of thin cells; returns the largest relative move of a mean."""
        total = max(n.sum(), 1e-9)
        self.pi = (n + 1e-6) / (total + 1e-6 * self.cells)
        grand = ex.sum(0) / total
        first = n.reshape(self.shape[0], -1)
        parent_n = first.sum(1)
        parent = (ex.reshape(self.shape[0], -1, self.d).sum(1) + SHRINK_MEAN * grand) / (parent_n + SHRINK_MEAN)[:, None]
        up = np.repeat(parent, first.shape[1], axis=0)
        mean = (ex + SHRINK_MEAN * up) / (n + SHRINK_MEAN)[:, None]
        scatter = exx - np.einsum("ci,cj->cij", ex, mean) - np.einsum("ci,cj->cij", mean, ex) + n[:, None, None] * np.einsum("ci,cj->cij", mean, mean)
        pooled = scatter.sum(0) / total + 1e-6 * np.eye(self.d)
        cov = (scatter + SHRINK_COV * pooled) / (n + SHRINK_COV)[:, None, None] + 1e-6 * np.eye(self.d)
        move = float(np.max(np.abs(mean - self.mean) / np.sqrt(np.diag(pooled)))) if self.cells else 0.0
        self.mean, self.cov = mean, cov
        return move

    def _consistent(self, key: np.ndarray) -> np.ndarray:
        """The cells a row may belong to whose category numbers are ``key`` (-1: unknown)."""
        return np.ravel(np.arange(self.cells).reshape(self.shape)[tuple(slice(None) if k < 0 else k for k in key)])

    def weights(self, cats: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
        """Responsibilities: for each group of rows with the same known categories and pattern of observed numbers
        (row numbers, pattern, cells they may belong to, rows by cells)."""
        bits = (~np.isnan(x)) @ (1 << np.arange(self.d))
        keys, at = np.unique(np.column_stack([cats, bits]), axis=0, return_inverse=True)
        at = at.ravel()
        for g, key in enumerate(keys):
            which, cells, pattern = np.flatnonzero(at == g), self._consistent(key[:-1]), int(key[-1])
            log = np.tile(np.log(self.pi[cells]), (len(which), 1))
            o = [j for j in range(self.d) if pattern >> j & 1]
            if o and len(cells) > 1:
                cov = self.cov[cells][:, o][:, :, o]
                # whitened differences: one triangular factor a cell
                root = np.linalg.cholesky(np.linalg.inv(cov))
                diff = np.einsum("cji,rcj->rci", root, x[which][:, None, o] - self.mean[cells][None][:, :, o])
                log -= 0.5 * ((diff**2).sum(2) + np.linalg.slogdet(cov)[1][None])
            log -= log.max(1, keepdims=True)
            r = np.exp(log)
            yield which, pattern, cells, r / r.sum(1, keepdims=True)

    def fill(self, cats: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers with missing ones replaced by conditional expectations, and the most probable cell of each row."""
        out, cell = x.copy(), np.zeros(len(x), dtype=int)
        sure = (cats >= 0).all(1)
        bits = (~np.isnan(x)) @ (1 << np.arange(self.d))
        if sure.any():
            cell[sure] = np.ravel_multi_index(cats[sure].T, self.shape)
            for pattern in np.unique(bits[sure]):
                which = np.flatnonzero(sure & (bits == pattern))
                o, m, b, _ = self.conditional(int(pattern))
                if len(m):
                    c = cell[which]
                    out[np.ix_(which, m)] = self.mean[c][:, m] + np.einsum("rmo,ro->rm", b[c], x[which][:, o] - self.mean[c][:, o])
        loose = np.flatnonzero(~sure)
        if len(loose):
            for rows, pattern, cells, r in self.weights(cats[loose], x[loose]):
                which = loose[rows]
                cell[which] = cells[r.argmax(1)]
                o, m, b, _ = self.conditional(pattern)
                if len(m):
                    diff = x[which][:, None, o] - self.mean[cells][None][:, :, o]
                    out[np.ix_(which, m)] = np.einsum("rc,rcm->rm", r, self.mean[cells][None][:, :, m] + np.einsum("cmo,rco->rcm", b[cells], diff))
        return out, cell


def _levels(df: DataFrame, categorical: list[str], most: int) -> list[list[str]]:
    out = []
    for c in categorical:
        top = df.groupBy(F.col(c).cast("string").alias("v")).count().filter(F.col("v").isNotNull()).orderBy(F.desc("count"), "v").limit(most).collect()
        out.append(sorted(r.v for r in top) + [OTHER])
    return out


def _cat(name: str, levels: list[str]) -> Column:
    m = F.create_map(*[x for i, v in enumerate(levels[:-1]) for x in (F.lit(v), F.lit(i))]) if len(levels) > 1 else None
    known = F.try_element_at(m, F.col(name).cast("string")) if m is not None else F.lit(None).cast("int")
    return F.when(F.col(name).isNull(), -1).otherwise(F.coalesce(known, F.lit(len(levels) - 1)))


def fit_mixture(df: DataFrame, numeric: list[str], categorical: list[str], max_categories: int = MAX_CATEGORIES, iterations: int = ITERATIONS) -> Mixture:
    """EM over all rows of ``df``; nulls in ``numeric`` and ``categorical`` are the missing values.

    One aggregation gathers the statistics of rows with known categories, at most cells x 2**len(numeric) rows; the
    driver holds those and the model only. Returns a mixture without cells if ``df`` has no observed number."""
    mix = Mixture(numeric, categorical, _levels(df, categorical, max_categories))
    d = len(numeric)
    coded = df.select(*[_cat(c, lv).alias(f"_k{j}") for j, (c, lv) in enumerate(zip(categorical, mix.levels))], *[F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(numeric)])
    pattern = sum((F.col(f"_x{j}").isNotNull().cast("int") * (1 << j) for j in range(d)), F.lit(0))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(f"_x{j}").alias(f"s{j}") for j in range(d)], *[F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"q{i}_{j}") for i, j in pairs]]
    keys = [f"_k{j}" for j in range(len(categorical))]
    stats = coded.groupBy(*keys, pattern.alias("pattern")).agg(*sums).toPandas().fillna(0.0)
    observed = {j: stats[(stats.pattern.to_numpy() >> j) % 2 == 1] for j in range(d)}
    counts = np.array([observed[j].n.sum() for j in range(d)], dtype=float)
    if not len(stats) or counts.max(initial=0) == 0:
        mix.cells = 0
        return mix
    centre = np.array([observed[j][f"s{j}"].sum() / max(counts[j], 1) for j in range(d)])
    spread = np.array([max(observed[j][f"q{j}_{j}"].sum() / max(counts[j], 1) - centre[j] ** 2, 1e-3) for j in range(d)])
    mix.start(centre, np.diag(spread))
    known = stats[(stats[keys] >= 0).all(axis=1)]
    groups = [_sums(mix, np.ravel_multi_index(part[keys].to_numpy(int).T, mix.shape), int(p), part, pairs) for p, part in known.groupby("pattern")]
    loose = Cut(coded.filter(F.least(*keys, F.lit(0)) < 0), "loose") if len(known) < len(stats) else None
    try:
        for step in range(iterations):
            n, ex, exx = np.zeros(mix.cells), np.zeros((mix.cells, d)), np.zeros((mix.cells, d, d))
            # the first step places the components by the rows whose cell is known
            more = _loose_statistics(loose.df, mix, keys, pairs) if loose is not None and step else []
            for cell, pat, rows, sx, sxx in [*groups, *more]:
                a, b = mix.expected(cell, pat, rows, sx, sxx)
                np.add.at(n, cell, rows)
                np.add.at(ex, cell, a)
                np.add.at(exx, cell, b)
            move = mix.maximise(n, ex, exx)
            mix.iterations = step + 1
            if step and move < TOLERANCE:
                break
    finally:
        if loose is not None:
            loose.drop()
    return mix


def _sums(mix: Mixture, cell: np.ndarray, pattern: int, part: pd.DataFrame, pairs: list[tuple[int, int]]) -> tuple:
    """Summed statistics of one pattern as arrays."""
    sxx = np.zeros((len(part), mix.d, mix.d))
    for i, j in pairs:
        sxx[:, i, j] = sxx[:, j, i] = part[f"q{i}_{j}"].to_numpy(float)
    return cell, pattern, part["n"].to_numpy(float), part[[f"s{j}" for j in range(mix.d)]].to_numpy(float), sxx


def _loose_statistics(loose: DataFrame, mix: Mixture, keys: list[str], pairs: list[tuple[int, int]]) -> list[tuple]:
    """Weighted sums of rows with an unknown category, per cell and pattern: summed in each partition, then over all."""
    d = mix.d
    xs = [f"_x{j}" for j in range(d)]
    cols = ["n", *[f"s{j}" for j in range(d)], *[f"q{i}_{j}" for i, j in pairs]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for at in range(0, len(pdf), 4000):
                part = pdf.iloc[at : at + 4000]
                x = part[xs].to_numpy(float)
                z = np.nan_to_num(x)
                v = np.column_stack([np.ones(len(z)), z, *[z[:, i] * z[:, j] for i, j in pairs]])
                for which, pattern, cells, r in mix.weights(part[keys].to_numpy(int), x):
                    total.setdefault(pattern, np.zeros((mix.cells, v.shape[1])))[cells] += r.T @ v[which]
        for pattern, sums in total.items():
            some = np.flatnonzero(sums[:, 0] > 1e-9)
            out = pd.DataFrame(sums[some], columns=cols)
            out.insert(0, "pattern", pattern)
            out.insert(0, "cell", some)
            yield out

    schema = "cell bigint, pattern bigint, " + ", ".join(f"{c} double" for c in cols)
    summed = loose.mapInPandas(run, schema).groupBy("cell", "pattern").agg(*[F.sum(c).alias(c) for c in cols]).toPandas()
    return [_sums(mix, part["cell"].to_numpy(int), int(p), part, pairs) for p, part in summed.groupby("pattern")]


def fill_missing(df: DataFrame, missing: dict[str, Column], categorical: dict[str, Column], group: list[Column] | None = None, id_col: str = "row_id", max_categories: int = MAX_CATEGORIES, bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Every row of ``df`` with the numeric fields of ``missing`` filled and marked.

    ``missing`` maps a numeric field to the condition under which its value is missing; ``categorical`` maps a name
    to the normalised category (null: unknown); ``group`` are the keys of records of the same thing (a null key or
    an empty first key: no group). A missing value becomes the mean of its group's present values, else the
    mixture's conditional expectation. The result has ``id_col``, and for each field f ``f`` (filled),
    ``f_filled`` (boolean) and ``f_how`` ('group' or 'mixture'; null where not filled), and for each category c
    ``c_filled_value`` (its own value or the mode) and ``c_filled``. A field stays null, and unmarked, only if no
    row of the table has a value. Repeated rows are filled alike; an empty table gives an empty one; columns of
    ``df`` with any name may exist, as only what is asked for is read."""
    fields, cats = list(missing), list(categorical)
    base = df.select(
        F.col(id_col).alias("_id"),
        *[F.when(~cond, F.col(f).cast("double")).alias(f"_v_{f}") for f, cond in missing.items()],
        *[c.alias(f"_c_{k}") for k, c in categorical.items()],
        *[g.alias(f"_g{i}") for i, g in enumerate(group or [])],
    )
    kept = Cut(base, "fill")
    base = kept.df
    mix = fit_mixture(base, [f"_v_{f}" for f in fields], [f"_c_{k}" for k in cats], max_categories)

    lacking = F.lit(False)
    for f in fields:
        lacking = lacking | F.col(f"_v_{f}").isNull()
    for k in cats:
        lacking = lacking | F.col(f"_c_{k}").isNull()
    whole, gaps = base.filter(~lacking), base.filter(lacking)

    if group:
        keys = [f"_g{i}" for i in range(len(group))]
        good = F.lit(True)
        for k in keys:
            good = good & F.col(k).isNotNull()
        good = good & (F.col(keys[0]) != "")
        means = base.filter(good).groupBy(*keys).agg(*[F.avg(f"_v_{f}").alias(f"_m_{f}") for f in fields])
        gaps = gaps.join(means, keys, "left")
    else:
        gaps = gaps.select("*", *[F.lit(None).cast("double").alias(f"_m_{f}") for f in fields])

    levels, shape = mix.levels, mix.shape
    gaps = gaps.select("*", *[_cat(f"_c_{k}", lv).alias(f"_k_{k}") for k, lv in zip(cats, levels)])
    out_fields = [f"{f} double, {f}_filled boolean, {f}_how string" for f in fields] + [f"{k}_filled_value string, {k}_filled boolean" for k in cats]
    id_type = dict(kept.df.dtypes)["_id"]
    schema = f"{id_col} {id_type}, " + ", ".join(out_fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 4000):
                part = pdf.iloc[at : at + 4000]
                own = part[[f"_v_{f}" for f in fields]].to_numpy(float)
                mean = part[[f"_m_{f}" for f in fields]].to_numpy(float)
                x = np.where(np.isnan(own), mean, own)
                code = part[[f"_k_{k}" for k in cats]].to_numpy(int)
                filled, cell = mix.fill(code, x) if mix.cells else (x, np.zeros(len(x), int))
                out = {id_col: part["_id"].to_numpy()}
                for j, f in enumerate(fields):
                    v = filled[:, j]
                    if bounds and f in bounds:
                        v = np.clip(v, *bounds[f])
                    gap = np.isnan(own[:, j])
                    mark = gap & ~np.isnan(v)
                    out[f] = np.where(gap, v, own[:, j])
                    out[f + "_filled"] = mark
                    out[f + "_how"] = np.where(~mark, None, np.where(np.isnan(mean[:, j]), "mixture", "group"))
                at_cell = np.array(np.unravel_index(cell, shape)) if mix.cells else None
                for j, k in enumerate(cats):
                    have = part[f"_c_{k}"].to_numpy(object)
                    mode = np.array([levels[j][i] for i in at_cell[j]], dtype=object) if at_cell is not None else np.array([None] * len(part), dtype=object)
                    lack = pd.isna(have)
                    out[f"{k}_filled_value"] = np.where(lack, np.where(mode == OTHER, None, mode), have)
                    out[f"{k}_filled"] = lack & (mode != OTHER) & ~pd.isna(mode)
                yield pd.DataFrame(out)

    need = ["_id", *[f"_v_{f}" for f in fields], *[f"_m_{f}" for f in fields], *[f"_c_{k}" for k in cats], *[f"_k_{k}" for k in cats]]
    done = gaps.select(*need).mapInPandas(run, schema)
    plain = whole.select(
        F.col("_id").alias(id_col),
        *[x for f in fields for x in (F.col(f"_v_{f}").alias(f), F.lit(False).alias(f"{f}_filled"), F.lit(None).cast("string").alias(f"{f}_how"))],
        *[x for k in cats for x in (F.col(f"_c_{k}").cast("string").alias(f"{k}_filled_value"), F.lit(False).alias(f"{k}_filled"))],
    )
    return plain.unionByName(done)


def fill_plants(plants: DataFrame) -> DataFrame:
    """:func:`fill_missing` for the register's ``lat``, ``lon`` and ``datein``: same plant, else same country and fuel."""
    from regfuse.functions.missing import LAT_RANGE, LON_RANGE, YEAR_RANGE, lat_missing, lon_missing, year_missing
    from regfuse.functions.plantnames import parsed
    from regfuse.functions.vocab import country_code, fuel_class

    p = plants.select("row_id", "lat", "lon", "datein", country_code("country").alias("_country"), fuel_class("fueltype", "technology").alias("_fuel"), parsed("name").alias("_name"))
    words = F.array_join(F.array_sort("_name.places"), " ")
    return fill_missing(
        p,
        {"lat": lat_missing(), "lon": lon_missing(), "datein": year_missing("datein")},
        {"country": F.col("_country"), "fuel": F.col("_fuel")},
        [words, F.col("_name.qual"), F.col("_country"), F.coalesce("_fuel", F.lit(""))],
        bounds={"lat": LAT_RANGE, "lon": LON_RANGE, "datein": YEAR_RANGE},
    )
