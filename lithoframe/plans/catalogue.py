"""The registered queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from lithoframe.plans import base, checked, grid, ident, reports, scene, spectra, statistics  # noqa: F401

FLAGSHIP = "pixel_statistics"


def queries():
    return dict(base.QUERIES)


def oracle_sql():
    return dict(base.SQL)
