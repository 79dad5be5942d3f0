"""Wide column names of smoothed series."""

from __future__ import annotations


def smooth_name(series: str, kernel: str, bandwidth: int) -> str:
    return f"{series}_{kernel}_{bandwidth}"


def parse_smooth_name(name: str) -> tuple[str, str, int]:
    series, kernel, bandwidth = name.rsplit("_", 2)
    return series, kernel, int(bandwidth)
