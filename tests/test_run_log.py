import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from terrane.operators.catalog import TableSet
from terrane.plans import export_run
from terrane.plans.export_run import RunLog

START = datetime(2024, 1, 1, 12, 30, 0, 123456, tzinfo=UTC)


def state(log):
    return {r["id"]: r.asDict(recursive=True) for r in log.runs().collect()}


def test_values_of_every_type_come_back(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"))
    log.append(7, status="IN_PROGRESS", rows_fetched=2**40, duration=0.5, is_spatial=False, fetch_timestamp=START)
    log.append(7, joined_tables={"main": "t", "join_1": None}, table_shapes=[{"rows": 3, "cols": 2}], sf_query_ids=["a", "é\n"])
    for _ in range(2):
        row = log.run(7)
        assert (row["status"], row["rows_fetched"], row["duration"], row["is_spatial"]) == ("IN_PROGRESS", 2**40, 0.5, False)
        assert row["fetch_timestamp"].astimezone(UTC) == START if row["fetch_timestamp"].tzinfo else row["fetch_timestamp"].timestamp() == START.timestamp()
        assert row["joined_tables"] == {"main": "t", "join_1": None}
        assert row["table_shapes"][0].asDict() == {"rows": 3, "cols": 2} and row["sf_query_ids"] == ["a", "é\n"]
        log.compact()
    assert log.run(8) is None
    with pytest.raises(ValueError, match="no field colour"):
        log.append(7, colour="red")


def test_random_events_in_any_order_with_compactions_and_repeats(spark, tmp_path):
    rng = random.Random(3)
    events = []
    for run in range(1, 6):
        for step in range(1, 7):
            names = rng.sample(["status", "duration", "output_path", "rows_fetched"], rng.randint(0, 3))
            made = {"status": f"S{step}", "duration": step / 2, "output_path": f"p{step}", "rows_fetched": step}
            events.append((run, step, {n: made[n] for n in names}))
    expected, steps = {}, set()
    for run, step, fields in events:
        expected.setdefault(run, {}).update(fields)
        if "status" in fields:
            steps.add((run, step, fields["status"]))
    rng.shuffle(events)
    log = RunLog(spark, str(tmp_path / "log"))
    for i, (run, step, fields) in enumerate(events):
        log.append(run, step, **fields)
        if i in (9, 20):
            log.compact()
        if i % 7 == 0:
            # A repeat with other values, as a rerun would bring: what is there stays.
            log.append(run, step, status="AGAIN")
    found = state(log)
    for run, fields in expected.items():
        assert {n: found[run][n] for n in ("status", "duration", "output_path", "rows_fetched")} == {
            n: fields.get(n) for n in ("status", "duration", "output_path", "rows_fetched")
        }
    assert {tuple(r) for r in log.status_steps().collect()} == steps


def test_repeat_after_its_file_was_folded_and_deleted(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"))
    log.append(1, 1, status="UNKNOWN")
    log.compact()
    log.append(2, 1, status="UNKNOWN")
    log.compact()
    assert not (tmp_path / "log/tail/1-1.json").exists() and (tmp_path / "log/tail/2-1.json").exists()
    before = state(log)
    log.append(1, 1, status="OTHER", output_path="x")
    after = state(log)
    assert after[1]["status"] == "UNKNOWN" and after[2] == before[2]
    assert [tuple(r) for r in log.status_steps().orderBy("id").collect()] == [(1, 1, "UNKNOWN"), (2, 1, "UNKNOWN")]
    assert len(list((tmp_path / "log/snapshots").glob("*.json"))) == 2 and log.compact() and log.compact() is None


def test_one_run_reads_the_snapshot_and_its_own_tail(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"))
    for run in range(1, 20):
        log.append(run, status="A")
    name = log.compact()
    for run in range(1, 20):
        log.append(run, status="B")
    frame = log.state(11)
    files = [f.rsplit("/", 1)[1] for f in frame.inputFiles() if "/tail/" in f]
    assert files == ["11-2.json"] and all(f"/{name}/" in f for f in frame.inputFiles() if "/tail/" not in f)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,11)" in plan
    assert log.run(11)["status"] == "B" and log.run(1)["status"] == "B"
    # Another log object goes on after the last step; no clock is asked.
    assert RunLog(spark, str(tmp_path / "log")).append(11, status="C") == 3
    assert log.run(11)["status"] == "C"


def test_half_a_compaction_and_two_at_once(spark, tmp_path):
    log, other = (RunLog(spark, str(tmp_path / "log")) for _ in range(2))
    log.append(1, status="A")
    log.compact()
    log.append(1, status="B")
    # A snapshot without its list does not stand.
    half = export_run.fold(None, export_run.state_of(log.events())).withColumn("status", F.lit(None).cast("struct<step:bigint,value:string>"))
    half.write.parquet(str(tmp_path / "log/snapshots/000000000099-x"))
    assert log.run(1)["status"] == "B"
    base, folded = log._base()
    names = log._tail(folded)
    fresh = export_run.state_of(log._events(names))
    log._settle(base, folded, names, fresh)
    other.append(2, 1, status="Z")
    other._settle(base, folded, names, fresh)
    assert {k: v["status"] for k, v in state(log).items()} == {1: "B", 2: "Z"}


def test_compacts_by_itself_and_loads_tables(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"), compact_after=3)
    for i in range(4):
        log.append(1, duration=float(i))
    assert log.events().count() == 1 and log.run(1)["duration"] == 3.0
    log.load(spark.createDataFrame([(1, 9, "LAST"), (5, 1, None)], "id long, step long, status string"))
    found = state(log)
    assert found[1]["status"] == "LAST" and found[1]["duration"] == 3.0 and found[5]["status"] is None
    assert log.events().count() == 0


def test_empty_log_and_given_id(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"))
    assert log.runs().count() == 0 and log.compact() is None and log.performance().count() == 0
    table_set = TableSet("A_1", "A_TERRITORY_1")
    assert log.register(table_set, 5) == 5
    first = log.run(5)
    assert log.register(table_set, 5) == 5 and log.run(5) == first
    assert first["fetch_timestamp"] is not None and timedelta(0) == first["fetch_timestamp"] - first["sf_data_timestamp"]


def test_load_folds_only_its_fields_and_a_log_without_tail_is_its_snapshot(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"))
    log.load(spark.createDataFrame([(1, 1, "A", 5.0, "p"), (2, 1, "A", None, None)], "id long, step long, status string, duration double, output_path string"))
    log.load(spark.createDataFrame([(1, 2, "B"), (3, 1, "C")], "id long, step long, status string"))
    frame = log.state()
    assert "Aggregate" not in frame._jdf.queryExecution().executedPlan().toString()
    found = {r["id"]: (r["status"], r["duration"], r["output_path"]) for r in log.runs().collect()}
    assert found == {1: ("B", 5.0, "p"), 2: ("A", None, None), 3: ("C", None, None)}
    assert log.run(1)["status"] == "B" and log.run(9) is None
