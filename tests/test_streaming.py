"""Stream = batch on the same delivery order, over several micro-batches."""

import tempfile

import pytest
from pyspark.sql import functions as F

from tracefold.operators.conformance import Model, check
from tracefold.params import Params
from tracefold.sources.messages import as_messages
from tracefold.sources.tables import orders_log
from tracefold.streaming.checker import case_states, check_stream
from tracefold.streaming.io import message_files, write_responses

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("order", ["none", "ngrams"])
def test_stream_equals_batch(spark, order):
    folder = tempfile.mkdtemp(prefix="stream-")
    log = orders_log(spark, SF).filter("arrival_seq < 450")
    model, p = Model(orders_log(spark, SF)), Params(order=order)
    for part in range(3):  # delivery in three files, in order
        chunk = log.filter(F.col("arrival_seq").between(part * 150, part * 150 + 149))
        as_messages(chunk).coalesce(1).write.mode("append").json(f"{folder}/in")
    source = message_files(spark, f"{folder}/in", max_files=1)
    query = write_responses(check_stream(source, model, p, ttl_ms=3_600_000 if order == "ngrams" else None), f"{folder}/out", f"{folder}/cp", all_available=True)
    assert query.awaitTermination(120)
    assert query.exception() is None
    got = spark.read.parquet(f"{folder}/out")
    want = check(log, model, p, ewma_keys=["case_id"]).select(*got.columns)
    assert got.count() == 450
    assert got.exceptAll(want).count() == 0
    if order == "none":
        states = case_states(spark, f"{folder}/cp")
        last = want.groupBy("case_id").agg(F.max_by("n_states", "arrival_seq").alias("n"))
        assert states.count() == last.count()
        assert states.agg(F.sum("n_states")).first()[0] == last.agg(F.sum("n")).first()[0]
