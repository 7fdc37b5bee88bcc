import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import covariation as C
from tidemark.plans import dense, networks
from tidemark.sources.tables import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_every_dimension_takes_part(spark):
    got = dense.QUERIES["shrunk_partial_correlations"](spark, DATA).toPandas()
    e = table(spark, DATA, "embeddings").filter("label is not null").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("x")).toPandas()
    sizes = e.groupby("label").size()
    assert set(got.label) == set(sizes[sizes >= 5].index) and (got.groupby("label").size() == 64 * 63).all()
    label = got.label.iloc[0]
    want, _ = C.fit(np.stack(e[e.label == label].sort_values("vec_id").x), "pcor")
    mine = got[got.label == label]
    assert np.allclose(mine.weight, want[mine.src.astype(int), mine.dep.astype(int)], atol=1e-8)


def test_no_trait_is_left_out(spark):
    names = {r.name for r in table(spark, DATA, "trait_vocab").collect()}
    large = DATA.replace("sf0.001", "sf0.1")  # the smallest scale has no edges
    assert {r.dep for r in networks.QUERIES["matrix_pivot_unpivot"](spark, large).select("dep").distinct().collect()} == names
    rated = networks.QUERIES["mock_ratings"](spark, DATA)
    assert {r.name for r in rated.select("name").distinct().collect()} == names and rated.count() == len(names) * table(spark, DATA, "chunks").select("chunk_id").distinct().count()
