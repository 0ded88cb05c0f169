import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from tracefold.session import build_session

    session = build_session(shuffle=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_log(spark):
    """[(case, activity, seconds, arrival)] -> log."""
    from pyspark.sql import functions as F

    def make(rows):
        rows = [(c, a, float(t), i) for c, a, t, i in rows]
        df = spark.createDataFrame(rows, "case_id string, activity string, event_time double, arrival_seq bigint")
        return df.withColumn("event_time", F.timestamp_micros((F.col("event_time") * 1_000_000).cast("bigint")))

    return make


FIXTURE_TRACES = {"123": "AABCBDE", "223": "AABDEF", "323": "AAACBDE"}


@pytest.fixture(scope="session")
def fixture_log(make_log):
    rows, n = [], 0
    for case, trace in FIXTURE_TRACES.items():
        for i, a in enumerate(trace):
            rows.append((case, a, float(i), n))
            n += 1
    return make_log(rows)


@pytest.fixture(scope="session")
def fixture_model(fixture_log):
    from tracefold.operators.conformance import Model

    return Model(fixture_log)
