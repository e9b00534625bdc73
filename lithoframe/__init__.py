"""Spark-first analytics over multi-sensor spectral rasters."""

__version__ = "0.1.0"
