"""Spectra that point away from their reference are dropped by the query, however Spark orders filter and projection."""

import numpy as np
import pytest

from lithoframe.plans import catalogue


@pytest.mark.parametrize("files", [1, 4])
def test_spectra_that_point_away(spark, tmp_path, files):
    r = 0.1 + np.random.default_rng(0).random(64)
    v = [(k, [float(x) for x in (-15 * r if k % 100 == 7 else r)], k // 100) for k in range(300)]
    spark.createDataFrame(v, "vec_id long, embedding array<float>, label int").repartition(files).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {x.vec_id for x in catalogue.queries()["cone_project"](spark, str(tmp_path)).collect()}
    assert got == {k for k in range(300) if k % 100 != 7}
    assert catalogue.queries()["cone_diagnostics"](spark, str(tmp_path)).first().n == 297
