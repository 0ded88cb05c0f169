"""Files in the formats of the published experiments."""

import gzip
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracefold.functions import labels
from tracefold.operators import experiments
from tracefold.operators import model as md
from tracefold.params import Params
from tracefold.sources import csvlog, messages, xes

XES = """<?xml version="1.0" encoding="UTF-8" ?>
<log>
{classifier}
<trace><string key="concept:name" value="t1"/>
 <event><string key="concept:name" value="A"/><string key="org" value="x"/><date key="time:timestamp" value="2011-10-02T12:42:12.094+00:00"/></event>
 <event><string key="concept:name" value="B"/><string key="org" value="y"/><date key="time:timestamp" value="2011-10-01T12:42:12.094+02:00"/></event>
</trace>
<trace><string key="concept:name" value="t2"/>
 <event><string key="concept:name" value="A"/><string key="org" value="x"/><date key="time:timestamp" value="2011-10-03T00:00:00.000Z"/></event>
</trace>
<trace><string key="concept:name" value="empty"/></trace>
</log>
"""


@pytest.mark.parametrize("suffix", ["xes", "xes.gz"])
@pytest.mark.parametrize("key", [None, "org"])
def test_xes(spark, suffix, key):
    folder = Path(tempfile.mkdtemp(prefix="xes-"))
    text = XES.format(classifier=f'<classifier name="c" keys="{key} concept:name"/>' if key else "")
    path = folder / f"log.{suffix}"
    (gzip.open(path, "wt") if suffix.endswith("gz") else open(path, "w")).write(text)
    log = xes.read_xes(spark, str(path))
    rows = [(r["case_id"], r["activity"]) for r in log.orderBy("arrival_seq").collect()]
    assert rows == ([("t1", "x"), ("t1", "y"), ("t2", "x")] if key else [("t1", "A"), ("t1", "B"), ("t2", "A")])
    times = [r["t"] for r in log.orderBy("arrival_seq").select(F.unix_millis("event_time").alias("t")).collect()]
    assert times[0] == 1317559332094 and times[1] == 1317465732094
    # document order makes the trace, not time; the empty trace has none
    found = {r["case_id"]: "".join(r["trace"]) for r in md.traces(md.trace_rows(log, md.BY_ARRIVAL)).collect()}
    assert found == ({"t1": "xy", "t2": "x"} if key else {"t1": "AB", "t2": "A"})


def test_csv_settings_and_table(spark):
    folder = tempfile.mkdtemp(prefix="csv-")
    head = ",case:concept:name,concept:name,time:timestamp\n"
    lines = ["0,123,A,2011-10-02T12:42:12.094000+0000\n", "1,123,B,2011-10-02T12:42:14.078000+0000\n", "2,9,C,2011-10-02T12:42:15.078000+0000\n"]
    Path(folder, "d.csv").write_text(head + "".join(lines))
    Path(folder, "10.csv").write_text(head + lines[1] + lines[0] + lines[2])
    log = csvlog.read_csv_logs(spark, folder, "d")
    got = {s: [r["activity"] for r in log.filter(F.col("setting") == s).orderBy("arrival_seq").collect()] for s in ("00", "10", "20")}
    assert got == {"00": ["A", "B", "C"], "10": ["B", "A", "C"], "20": []}
    assert log.select(F.unix_millis("event_time")).first()[0] in (1317559332094, 1317559334078)
    csvlog.write_logs(log, f"{folder}/table")
    assert csvlog.read_logs(spark, f"{folder}/table").count() == 6


def test_messages_round_trip_and_control(spark, fixture_log):
    sent = messages.as_messages(fixture_log)
    test = spark.createDataFrame([("stream/test/test", '{"event":{"concept:name":"test","time:timestamp":"2024-01-01T01:01:01.179+01:00"}}', 99)], messages.MESSAGE_SCHEMA)
    got = messages.parse_messages(sent.unionByName(test))
    assert got.count() == 20 and got.exceptAll(fixture_log.select(*got.columns)).count() == 0
    assert test.select(F.unix_millis(messages.parse_time(F.get_json_object("payload", "$.event['time:timestamp']")))).first()[0] == 1704067261179


@pytest.mark.parametrize(
    "kind, name, want",
    [
        ("orig", "d__algo_ngrams__swap_10_3_0.3_20240101_120000", {"dataset": "d", "algo": "ngrams", "swap": "10"}),
        ("noise", "d__noise_05__algo_greedy__swap_01_3_0.3_20240101_120000", {"dataset": "d", "noise": "05", "algo": "greedy", "swap": "01"}),
        ("ewma", "d__ewma_0.005__swap_50_ngrams_3_0.3_20240101_120000", {"dataset": "d", "ewma": "0.005", "swap": "50"}),
    ],
)
def test_result_files_and_summary(spark, kind, name, want):
    folder = Path(tempfile.mkdtemp(prefix="res-"))
    (folder / name).mkdir()
    (folder / name / "part-0-0").write_text("c1,A,0,2,1000\nc1,B,3,2,1001\nc2,A,1,4,1001\nc1,C,2,2,1002\n")
    rows = experiments.read_results(spark, str(folder), kind)
    keys = list(want)
    cases = experiments.per_case(rows, keys)
    got = {r["case_id"]: (r["total_time_ms"], r["cost"], r["event_count"]) for r in cases.collect()}
    assert got == {"c1": (6, 2, 3), "c2": (4, 1, 1)}
    total = experiments.per_setting(cases, keys).first()
    assert {k: total[k] for k in keys} == want
    assert total["case_count"] == 2 and total["cost_per_trace"] == 1.5 and total["time_per_event_ms"] == 2.5
    experiments.write_summary(experiments.per_setting(cases, keys), str(folder / "summary"), keys)
    assert spark.read.option("header", "true").csv(str(folder / "summary")).count() == 1


def test_run_label():
    assert labels.run_label("x", Params(order="ngrams")) == "x_freqrandom__3_0.3"
    assert labels.run_label("x", Params(event_time_aware=False)) == "x_notaware__notadaptable__3_0.3"
