import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from vellumine.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate a column expression over one text."""
    from pyspark.sql import functions as F

    def run(build, *texts):
        df = spark.createDataFrame([texts], [f"c{i}" for i in range(len(texts))])
        return df.select(build(*[F.col(c) for c in df.columns]).alias("v")).first()["v"]

    return run
