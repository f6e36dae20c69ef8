"""Contour analytics on Spark: scan, resample, warp, categorise and summarise ragged frequency contours."""

__version__ = "0.1.0"
