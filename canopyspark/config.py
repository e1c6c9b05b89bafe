"""Thresholds of the change analytics, in integer units so that both sides of a comparison are exact."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """milli-dB thresholds, pixel sizes and weights; fixed values of the published method."""

    side: int = 256
    forest_min: int = -11000
    drop_min: int = 3000
    water_max: int = -18000
    model_drop_min: int = 1500
    tailings_drop: int = 5000
    min_patch_px: int = 50
    event: str = "2019-02-19"
    days_per_month: float = 30.4375
    weights: tuple[int, ...] = (30, 20, 25, 15, 10)
    dates: tuple[str, ...] = ("2018-12-01", "2019-01-05", "2019-03-01", "2019-06-01", "2019-12-01", "2020-03-01")


CONFIG = Config()
