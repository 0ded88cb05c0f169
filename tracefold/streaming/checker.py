"""The checker on an unbounded stream: one state per case, kept by Spark's state store.

Do not put a watermark before it: late events are what it repairs.  The adaptive multiplier follows each case by itself,
because state of one key cannot see the others; ``check(..., ewma_keys=["case_id"])`` is the batch twin.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tracefold.functions import step, tree
from tracefold.operators.conformance import Model
from tracefold.operators.hot_fold import RESULT, RESULT_DDL
from tracefold.params import Params
from tracefold.sources.messages import usable

# fixed once: a change makes written checkpoints unreadable
STATE = StructType([StructField("state", StringType()), StructField("n_states", IntegerType()), StructField("open_events", IntegerType())])
OUTPUT = f"case_id string, activity string, event_time timestamp, arrival_seq bigint, {RESULT_DDL}"


class CaseProcessor(StatefulProcessor):
    def __init__(self, model_path: str, params: Params, ttl_ms: int | None):
        self._model_path, self._params, self._ttl = model_path, params, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._case = handle.getValueState("case", STATE, self._ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        model, p = tree.published_tree(self._model_path), self._params
        model.rest()
        case = step.Case.load(json.loads(self._case.get()[0]), model) if self._case.exists() else step.Case(p.multiplier)
        # one key's rows may come in several frames and in any order
        batch = pd.concat(list(rows)).sort_values("arrival_seq", kind="stable")
        out = []
        for activity, ms in zip(batch["activity"], batch["ts_ms"].tolist()):
            flag, redone = step.observe(model, p, case, model.number.get(activity, activity), ms, None)
            out.append((case.cost, step.states(case), case.gens[0][0], flag, redone, step.complete_cost(model, case)))
        self._case.update((json.dumps(case.dump(model)), step.states(case), case.gens[0][0]))
        done = batch[["case_id", "activity", "event_time", "arrival_seq"]].reset_index(drop=True)
        result = pd.DataFrame(out, columns=RESULT)
        result["flag"] = result["flag"].astype("Int32")
        yield pd.concat([done, result], axis=1)

    def close(self) -> None:
        pass


def check_stream(log: DataFrame, model: Model, params: Params = Params(), ttl_ms: int | None = None) -> DataFrame:
    """One row per usable event, appended.  ``ttl_ms`` forgets cases that have not been seen for that long.

    ``messages.rejected(log)`` has the events that are not usable.
    """
    published = model.publish(params.order == "ngrams")
    keyed = usable(log).withColumn("ts_ms", F.unix_millis("event_time")).groupBy("case_id")
    return keyed.transformWithStateInPandas(
        statefulProcessor=CaseProcessor(published, params, ttl_ms),
        outputStructType=StructType.fromDDL(OUTPUT),
        outputMode="append",
        timeMode="ProcessingTime" if ttl_ms else "None",
    )


def case_states(spark, checkpoint: str) -> DataFrame:
    """Cases and their numbers of states in the checkpoint of a query (Spark's state reader)."""
    raw = spark.read.format("statestore").option("stateVarName", "case").load(checkpoint)
    return raw.select(F.col("key.*"), F.col("value.n_states").alias("n_states"), F.col("value.open_events").alias("open_events"))
