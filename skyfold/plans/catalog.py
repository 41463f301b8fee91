"""All registered queries of the library, each with its equivalent SQL where there is one."""

from __future__ import annotations

from . import chain, geo, kernels, products, rasters, series, stats, times  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
