"""Composite pipelines: several operators in the order in which a study needs them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import raster


def prepare_population(pixels: DataFrame, uninhabited: DataFrame, districts: DataFrame, cell: float, size: float = 15001.0) -> DataFrame:
    """Population raster without uninhabited areas, with its mass kept and each district scaled to its reference."""
    fine = raster.rasterize(uninhabited, cell / 10, F.lit(1.0), F.lit(0))
    share = raster.resample_avg(fine, 10)
    masked = raster.mask_population(pixels, share)
    kept = raster.rescale_mass(pixels, masked)
    return raster.calibrate(kept, districts, cell, "zone_no", "reference", size)
