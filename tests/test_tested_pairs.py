import os

import pytest
from pyspark.sql import functions as F

from kinweave.plans import driver_queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
def test_every_pair_of_a_label_is_tested(spark):
    """The pairs used to be those among vectors 8 to 30 behind a gene."""
    e = driver_queries.read(spark, SMALL, "embeddings").groupBy("label").agg(
        F.count_if(F.col("vec_id") % 5 == 0).alias("g"), F.count_if(F.col("vec_id") % 5 != 0).alias("p")
    )
    wanted = e.agg(F.sum(F.col("g") * F.col("p"))).first()[0]
    assert driver_queries.tested_pairs(spark, SMALL).count() == wanted
    assert driver_queries.observed(spark, SMALL).groupBy("rep").count().select("count").distinct().collect() == [(wanted,)]
