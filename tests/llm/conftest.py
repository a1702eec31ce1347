import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A documents table from (doc_id, text), with columns whose names operators also use."""

    def build(items):
        frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in items], DOCS)
        clash = ("row", "keep", "block", "digest", "score", "top", "group", "x", "p", "kept")
        return frame.withColumns({name: F.lit(None).cast("string") for name in clash})

    return build
