"""Grids whose last row is short, against DuckDB: sums run over the pixels that there are, and others have no row."""

import math

import duckdb
import numpy as np
import pytest

from lithoframe.plans import catalogue

NAMES = ["gaussian_blur", "area_downsample", "bicubic_upsample", "bilateral_filter", "box_mean", "diffusion_step", "dilate_erode", "dog_bandpass", "guided_filter", "local_correlation", "log_high_pass", "sobel_gradient", "scharr_log_gradient", "weighted_gaussian", "nullspace_project", "band_noise", "structure_gradient", "high_frequency_energy", "column_profile", "edge_f1", "area_downsample_fractional", "band_identifiability", "blocked_cv", "blocked_cv_folds", "amplitude_summary", "shift_null"]
#: Rows of the table: 53 rows of the grid, the last with 16, 4 and one pixel; 51 with 2.
SIZES = (1056, 1044, 1041, 1002)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    out = []
    for n in SIZES:
        at = tmp_path_factory.mktemp(f"n{n}")
        rows = [(k, [float(x) for x in v], int(k % 3)) for k, v in enumerate(0.1 * np.random.default_rng(n).standard_normal((n, 64)))]
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{at}/embeddings.parquet")
        db = duckdb.connect()
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{at}/embeddings.parquet/*.parquet'")
        out.append((str(at), db))
    return out


def plain(v):
    return (None if math.isnan(v) else float(f"{v:.9g}")) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, tables, name):
    for at, db in tables:
        df, rel = catalogue.queries()[name](spark, at), db.sql(catalogue.oracle_sql()[name])
        cols = sorted(df.columns)
        mine = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
        assert mine == sorted(repr([plain(r[rel.columns.index(c)]) for c in cols]) for r in rel.fetchall())
