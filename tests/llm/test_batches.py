"""Texts reach Python workers in batches that are bounded by bytes."""

import pyarrow as pa

from corvane.llm._common import BATCH_BYTES, light_batches

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_light_batches(spark):
    before = spark.conf.get(NAME)
    try:
        spark.conf.set(NAME, "64m")
        light_batches(spark)
        assert spark.conf.get(NAME) == str(BATCH_BYTES)

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

        texts = spark.range(0, 4000, 1, 1).selectExpr("repeat('x', 5000) AS text")
        got = texts.mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r["n"] for r in got) == 4000
        assert max(r["bytes"] for r in got) < 2 * BATCH_BYTES
        spark.conf.set(NAME, "1m")  # a lower bound of the user's own stands
        light_batches(spark)
        assert spark.conf.get(NAME) == "1m"
    finally:
        spark.conf.set(NAME, before)
