import pytest
from pyspark.sql import functions as F

TEXTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Build documents from (doc_id, text) pairs, with nulls elsewhere and columns whose names operators use inside."""
    def make(rows):
        d = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], TEXTS)
        for name in ("fingerprint", "component_id", "score", "text_key", "runs", "ids", "piece", "rank"):
            d = d.withColumn(name, F.lit(7))
        return d
    return make
