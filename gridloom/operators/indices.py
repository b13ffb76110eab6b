"""Named index series from the modes of anomalies in a box."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import coupled, grid, season
from gridloom.operators.modes import ec_rotation

#: Boxes (latitudes, longitudes in [-180, 180), east of west over the date line) and the modes that are taken from them.
BOXES = {"EC": (-5, 5, 170, -80), "SPO": (-45, -10, -160, -70), "NPO": (20, 85, 120, -120), "PSA": (-90, 90, -180, 180)}
MODES = {"EC": 2, "SPO": 1, "NPO": 2, "PSA": 3}


def box_modes(anomalies: DataFrame, box: tuple[float, float, float, float], k: int, signs: str = "mean") -> tuple[DataFrame, DataFrame, list, coupled.Modes]:
    """The cells of a box with a value at all times, their anomalies weighted by the root of the cosine of latitude; the patterns; the times;
    and the first ``k`` modes. anomalies: ``lat, lon, season, value``. signs: 'mean' turns a mode so that the mean of its weighted
    pattern is positive, 'largest' as ``principal`` has it."""
    weight = grid.sqrt_weight(F.col("lat"))
    rows = anomalies.filter(grid.in_box(*box)).select("lat", "lon", "season", (F.col("value") * weight).alias("value"), weight.alias("weight"))
    seasons = [r.season for r in rows.select("season").distinct().orderBy("season").collect()]
    cells = coupled.series(rows, ["lat", "lon"], len(seasons))
    modes = coupled.principal(coupled.time_gram(cells, len(seasons)), k)
    if signs == "mean" and len(seasons):
        unit = cells.select("lat", "lon", F.lit(1.0).alias("weight"), "x")
        patterns = coupled.inflated(unit, ["lat", "lon"], modes.left_projection, _unit_spread(modes.left.shape))
        mean = {r.mode: r.m for r in patterns.groupBy("mode").agg(F.avg("pattern").alias("m")).collect()}
        turn = np.array([-1.0 if mean.get(m + 1, 0.0) < 0 else 1.0 for m in range(modes.left.shape[1])])
        modes = modes._replace(left=modes.left * turn, right=modes.right * turn, left_projection=modes.left_projection * turn, right_projection=modes.right_projection * turn)
    return cells, coupled.inflated(cells, ["lat", "lon"], modes.left_projection, modes.left), seasons, modes


def _unit_spread(shape: tuple[int, int]) -> np.ndarray:
    """Columns with a standard deviation of 1."""
    x = np.zeros(shape)
    x[::2], x[1::2] = 1.0, -1.0
    return (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)


def named(anomalies: DataFrame, name: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """``season, name, value``: a named index, standardised by calendar month. EC gives the E and C indices from the first two modes of the
    equatorial Pacific, SPO and NPO the first and second mode of pressure, PSA the second and third mode of height as PSA1 and PSA2."""
    _, _, seasons, modes = box_modes(anomalies, box or BOXES[name], MODES[name], "largest" if name == "EC" else "mean")
    pc = modes.left
    if pc.shape[1] < MODES[name]:
        raise ValueError(f"{name}: the box has fewer than {MODES[name]} modes")
    if name == "EC":
        e, c = ec_rotation(pc[:, 0], pc[:, 1])
        out = {"E": e, "C": c}
    else:
        out = {"SPO": {"SPO": 0}, "NPO": {"NPO": 1}, "PSA": {"PSA1": 1, "PSA2": 2}}[name]
        out = {n: pc[:, m] for n, m in out.items()}
    rows = [(s, n, float(v[i])) for n, v in out.items() for i, s in enumerate(seasons)]
    df = anomalies.sparkSession.createDataFrame(rows, "season date, name string, value double")
    return season.zscore_month(df, ["name"], "value", "value")
