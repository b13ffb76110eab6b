"""Winds on the sphere: stream function, velocity potential, Rossby-wave source, by spherical harmonics.

A time step's (or level's) global grid is one group: latitudes x longitudes, fixed by the grid's resolution however long the record is. A
group is transformed by an FFT along longitude and a least-squares fit of associated Legendre functions along latitude.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from gridloom.operators.calculus import EARTH_RADIUS

OMEGA = 7.292e-5


def legendre(order: int, most: int, lat: np.ndarray) -> np.ndarray:
    """Orthonormal associated Legendre functions of one order, degrees ``order`` to ``most``: latitudes x degrees."""
    x, c = np.sin(lat), np.cos(lat)
    out = np.zeros((len(lat), most - order + 1))
    p = np.full(len(lat), np.sqrt(0.5))
    for m in range(1, order + 1):
        p = p * np.sqrt((2 * m + 1) / (2 * m)) * c
    out[:, 0] = p
    if most > order:
        out[:, 1] = np.sqrt(2 * order + 3) * x * p
    for n in range(order + 2, most + 1):
        a = np.sqrt((4 * n * n - 1) / (n * n - order * order))
        b = np.sqrt(((n - 1) ** 2 - order * order) / (4 * (n - 1) ** 2 - 1))
        out[:, n - order] = a * (x * out[:, n - order - 1] - b * out[:, n - order - 2])
    return out


def d_legendre(order: int, most: int, lat: np.ndarray) -> np.ndarray:
    """cos(lat) times the derivative by latitude."""
    wide = legendre(order, most + 1, lat)
    n = np.arange(order, most + 1)
    eps = lambda k: np.sqrt(np.maximum(k * k - order * order, 0) / np.maximum(4.0 * k * k - 1, 1e-300))
    lower = np.concatenate([np.zeros((len(lat), 1)), wide[:, :-2]], axis=1)
    return (n + 1) * eps(n) * lower - n * eps(n + 1) * wide[:, 1:]


class Sphere:
    def __init__(self, lat: np.ndarray, n_lon: int):
        self.lat, self.n_lon = np.radians(lat), n_lon
        self.most = min(len(lat) - 1, (n_lon - 1) // 2)
        inner = np.abs(np.cos(self.lat)) > 1e-9
        self.inner, self.cos = inner, np.where(inner, np.cos(self.lat), 1.0)
        self.p = [legendre(m, self.most, self.lat) for m in range(self.most + 1)]
        self.h = [d_legendre(m, self.most, self.lat) for m in range(self.most + 1)]
        weight = np.sqrt(np.maximum(np.cos(self.lat), 1e-6))[:, None]
        self.weight = weight
        self.fit = [np.linalg.pinv(weight * p) for p in self.p]

    def analyse(self, f: np.ndarray) -> list[np.ndarray]:
        g = np.fft.rfft(f, axis=1) / self.n_lon
        return [self.fit[m] @ (self.weight[:, 0] * g[:, m]) for m in range(self.most + 1)]

    def synthesise(self, c: list[np.ndarray], basis: list[np.ndarray] | None = None, factor=None) -> np.ndarray:
        g = np.zeros((len(self.lat), self.n_lon // 2 + 1), complex)
        for m in range(self.most + 1):
            g[:, m] = (basis or self.p)[m] @ (c[m] * (factor(m) if factor else 1))
        return np.fft.irfft(g * self.n_lon, n=self.n_lon, axis=1)

    def gradient(self, c: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Eastward and northward derivatives of a scalar; 0 at the poles."""
        east = self.synthesise(c, factor=lambda m: 1j * m)
        north = self.synthesise(c, self.h)
        scale = (self.inner / self.cos / EARTH_RADIUS)[:, None]
        return east * scale, north * scale

    def vorticity_divergence(self, u: np.ndarray, v: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Spectra of vorticity and divergence, by a fit of both potentials to the winds: u cos and v cos are linear in them."""
        uc, vc = (np.fft.rfft(f * np.cos(self.lat)[:, None], axis=1) / self.n_lon for f in (u, v))
        zeta, delta = [], []
        for m in range(self.most + 1):
            n = np.arange(m, self.most + 1)
            p, h = self.p[m], self.h[m]
            # a u cos = -cos d psi/d lat + d chi/d lon; a v cos = d psi/d lon + cos d chi/d lat
            a = np.block([[-h, 1j * m * p], [1j * m * p, h]]) / EARTH_RADIUS
            keep = np.tile(n > 0, 2)
            x = np.zeros(2 * len(n), complex)
            x[keep] = np.linalg.lstsq(a[:, keep], np.concatenate([uc[:, m], vc[:, m]]), rcond=None)[0]
            lap = -n * (n + 1) / EARTH_RADIUS**2
            zeta.append(x[: len(n)] * lap)
            delta.append(x[len(n) :] * lap)
        return zeta, delta

    def inverse_laplacian(self, c: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for m in range(self.most + 1):
            n = np.arange(m, self.most + 1)
            out.append(np.where(n > 0, -c[m] * EARTH_RADIUS**2 / np.maximum(n * (n + 1), 1), 0))
        return out


@lru_cache(maxsize=4)
def sphere(lat: tuple[float, ...], n_lon: int) -> Sphere:
    return Sphere(np.array(lat), n_lon)


def diagnose(u: np.ndarray, v: np.ndarray, lat: np.ndarray) -> dict[str, np.ndarray]:
    """Stream function, velocity potential and Rossby-wave source -eta D - v_chi . grad eta of one global grid (latitudes x longitudes)."""
    s = sphere(tuple(lat.tolist()), u.shape[1])
    zeta, delta = s.vorticity_divergence(u, v)
    psi, chi = s.inverse_laplacian(zeta), s.inverse_laplacian(delta)
    eta = s.synthesise(zeta) + 2 * OMEGA * np.sin(np.radians(lat))[:, None]
    gx, gy = s.gradient(s.analyse(eta))
    ux, vx = s.gradient(chi)
    return {"psi": s.synthesise(psi), "chi": s.synthesise(chi), "rws": -eta * s.synthesise(delta) - (ux * gx + vx * gy)}


def fill_gaps(values: np.ndarray) -> np.ndarray:
    """Cubic splines through the known values of each row, then of each column; ends stay unknown. At the second and the last but one value
    the third derivative does not change, so a cubic is met exactly."""
    out = values.astype(float).copy()
    for view in (out, out.T):
        for row in view:
            known = np.flatnonzero(np.isfinite(row))
            if len(known) < 4 or len(known) == len(row):
                continue
            x, y = known.astype(float), row[known]
            h = np.diff(x)
            a = np.zeros((len(x), len(x)))
            b = np.zeros(len(x))
            a[0, :3] = h[1], -(h[0] + h[1]), h[0]
            a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
            for i in range(1, len(x) - 1):
                a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
                b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
            m = np.linalg.solve(a, b)
            for j in range(known[0], known[-1] + 1):
                if not np.isfinite(row[j]):
                    i = np.searchsorted(x, j) - 1
                    p, q = (x[i + 1] - j) / h[i], (j - x[i]) / h[i]
                    row[j] = p * y[i] + q * y[i + 1] + ((p**3 - p) * m[i] + (q**3 - q) * m[i + 1]) * h[i] ** 2 / 6
    return out


def wind_diagnostics(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, lat, lon, psi, chi, rws`` from ``keys, lat, lon, u, v``; each key's rows are one global grid."""
    fields = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = (fill_gaps(pdf.pivot(index="lat", columns="lon", values=c).sort_index().to_numpy(float)) for c in ("u", "v"))
        lat, lon = np.sort(pdf["lat"].unique()), np.sort(pdf["lon"].unique())
        found = diagnose(u, v, lat)
        yy, xx = np.meshgrid(lat, lon, indexing="ij")
        out = pd.DataFrame({"lat": yy.ravel(), "lon": xx.ravel(), **{k: x.ravel() for k, x in found.items()}})
        for c, value in zip(keys, key, strict=True):
            out[c] = value
        return out[[*keys, "lat", "lon", "psi", "chi", "rws"]]

    return df.groupBy(*keys).applyInPandas(one, f"{fields}, lat double, lon double, psi double, chi double, rws double")
