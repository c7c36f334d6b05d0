"""From coordinates to grid cells. A GridSpec travels with the data, as two rules of cell numbering exist."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ORDER = 23


@dataclass(frozen=True)
class GridSpec:
    """2^order cells a side over [x_origin, x_origin + width] x [y_origin, y_origin + height].

    mode "cell" numbers floor(v * n / extent), "inclusive" floor(v / extent * (n - 1)); both clamp to 0..n-1.
    """

    width: float
    height: float
    order: int = 8
    x_origin: float = 0.0
    y_origin: float = 0.0
    mode: str = "cell"

    def __post_init__(self) -> None:
        if not 1 <= self.order <= MAX_ORDER:
            raise ValueError(f"order must be 1 to {MAX_ORDER}: composite keys keep 48 bits for the curve")
        if self.mode not in ("cell", "inclusive"):
            raise ValueError(f"unknown mode {self.mode}")
        if not (self.width > 0 and self.height > 0):
            raise ValueError("width and height must be positive")

    @property
    def n(self) -> int:
        return 1 << self.order

    def _scaled(self, v, origin: float, extent: float):
        return (v - origin) * self.n / extent if self.mode == "cell" else (v - origin) / extent * (self.n - 1)

    def cell(self, x: float, y: float) -> tuple[int, int]:
        """The cell of a point; points outside are clamped, like their keys."""
        clamp = lambda v: min(max(int(v), 0), self.n - 1)
        return clamp(self._scaled(x, self.x_origin, self.width)), clamp(self._scaled(y, self.y_origin, self.height))

    def columns(self, x: Column, y: Column) -> tuple[Column, Column]:
        """The same as column expressions; NULL and NaN give NULL."""
        top = float(self.n - 1)

        def one(v: Column, origin: float, extent: float) -> Column:
            scaled = self._scaled(v.cast("double"), F.lit(float(origin)), F.lit(float(extent)))
            return F.when(scaled.isNotNull() & ~F.isnan(scaled), F.least(F.greatest(scaled, F.lit(0.0)), F.lit(top)).cast("long"))

        return one(x, self.x_origin, self.width), one(y, self.y_origin, self.height)


def padded_spec(df: DataFrame, x: str = "x", y: str = "y", order: int = 8, padding: float = 0.001) -> GridSpec:
    """A spec over the data's extent, widened by a share of its range; one aggregate row leaves the cluster."""
    r = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).first()
    if r["x0"] is None:
        raise ValueError("no rows")
    dx, dy = (r["x1"] - r["x0"]) * padding, (r["y1"] - r["y0"]) * padding
    return GridSpec(max(r["x1"] - r["x0"] + 2 * dx, 1e-12), max(r["y1"] - r["y0"] + 2 * dy, 1e-12), order, r["x0"] - dx, r["y0"] - dy)


def lonlat_spec(order: int = 10) -> GridSpec:
    """One grid for the globe."""
    return GridSpec(360.0, 180.0, order, -180.0, -90.0)


def tile_id(x: Column, y: Column, size: float = 256.0) -> Column:
    """"{column}_{row}" of square tiles."""
    return F.concat_ws("_", F.floor(x / F.lit(size)).cast("long"), F.floor(y / F.lit(size)).cast("long"))


def equirectangular(lon: Column, lat: Column, lon0: float, lat0: float, mean_lat: float) -> tuple[Column, Column]:
    """Metres east and north of (lon0, lat0), flat at mean_lat; a degree is 111320 m by 110540 m."""
    return (lon - lon0) * 111320.0 * F.cos(F.radians(F.lit(mean_lat))), (lat - lat0) * 110540.0


def valid(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Rows with finite coordinates; all others are rejected before keys are computed."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return df.where(finite(x) & finite(y))
