import tempfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import reshape as R
from tidemark.plans import insights as I
from tidemark.sources import store
from tidemark.streaming import live, refresh as job, runner

SPECS = [R.SheetSpec("Daily", "long", columns={"Price": ("price", "price")})]


def cells(spark, day, price, source="w", row=2):
    data = [(source, "Daily", 1, 1, "Date"), (source, "Daily", 1, 2, "Price"), (source, "Daily", row, 1, day), (source, "Daily", row, 2, price)]
    return spark.createDataFrame(data, store.CELLS)


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def test_refresh_writes_every_tier_and_reports(spark, folder, rows):
    c = cells(spark, "2024-01-01", "Closed").unionByName(cells(spark, "2024-01-02", "5", row=3).where("r > 1"))
    seen = []
    status = job.refresh(spark, c, SPECS, folder, "r1", then=[("analytics", lambda s, b, r: seen.append(r)), ("broken", lambda s, b, r: 1 / 0)])
    assert status["status"] == "ok" and status["analytics"] == "ok" and status["broken"].startswith("failed") and seen == ["r1"]
    assert status["sheets_validated"] == 1 and status["total_issues"] == 1
    clean = store.read_clean(spark, f"{folder}/clean", "Daily")
    assert [r["value"] for r in rows(clean, "ts")] == [5.0]
    assert spark.read.json(f"{folder}/cleaning_log").where("action = 'token_to_null'").count() == 1
    with pytest.raises(FileNotFoundError):
        store.read_clean(spark, f"{folder}/clean", "Nothing")
    assert job.refresh(spark, c.drop("v"), SPECS, folder, "r2")["status"] == "failed"
    broken = c.withColumn("v", F.when(F.col("r") > 1, F.raise_error(F.lit("unreadable cell")).cast("string")).otherwise(F.col("v")))
    assert "unreadable cell" in job.refresh(spark, broken, SPECS, folder, "r3")["error"]
    assert store.finished(spark, f"{folder}/raw") == ["r1"] and store.read_tier(spark, f"{folder}/raw").count() == 2  # never a version without its sheets


def test_watching_two_deliveries_equals_one(spark, folder, rows):
    landing, base = f"{folder}/landing", f"{folder}/base"
    first = cells(spark, "2024-01-01", "1")
    first.write.parquet(f"{landing}/d1")
    live.run_to_end(job.watch(spark, landing, SPECS, base))
    first.unionByName(cells(spark, "2024-01-02", "2", row=3).where("r > 1")).write.parquet(f"{landing}/d2")
    live.run_to_end(job.watch(spark, landing, SPECS, base, then=[("analytics", lambda s, b, r: None), ("broken", lambda s, b, r: 1 / 0)]))
    assert [r["value"] for r in rows(store.read_clean(spark, f"{base}/clean", "Daily"), "ts")] == [1.0, 2.0]
    seen = {(r["refresh_id"], r["step"]): r["status"] for r in spark.read.json(f"{base}/refreshes").collect()}
    assert seen["batch00000000", "refresh"] == seen["batch00000001", "refresh"] == seen["batch00000001", "analytics"] == "ok"
    assert seen["batch00000001", "broken"].startswith("failed")


def test_a_shorter_delivery_replaces_the_longer_one(spark, folder, rows):
    landing = f"{folder}/landing"
    long = cells(spark, "2024-01-01", "1").unionByName(cells(spark, "2024-01-02", "2", row=3).where("r > 1"))
    long.unionByName(cells(spark, "2024-01-01", "9", source="other")).repartition(3).write.parquet(f"{landing}/a")
    cells(spark, "2024-01-03", "3").repartition(2).write.parquet(f"{landing}/b")
    got = store.read_cells(spark, landing)
    assert sorted(r["v"] for r in got.where("source = 'w'").collect()) == ["2024-01-03", "3", "Date", "Price"]
    assert got.where("source = 'other'").count() == 4


def test_a_repeated_refresh_replaces_itself(spark, folder):
    c = cells(spark, "2024-01-01", "5")
    for rid in ("r1", "r1", "r2", "r3", "r3"):
        assert job.refresh(spark, c, SPECS, folder, rid)["status"] == "ok"
    assert store.finished(spark, f"{folder}/clean") == ["r2", "r3"] and store.read_clean(spark, f"{folder}/clean", "Daily").count() == 1
    assert spark.read.parquet(f"{folder}/quality").groupBy("refresh_id").count().where("count > 1").isEmpty()
    assert spark.read.parquet(f"{folder}/sheets").count() == 3


def test_tokens_duplicates_and_broken_sheets(spark, folder, monkeypatch):
    """A sheet's own token, an exact repeat of a row, a label that is no date, and a sheet that cannot be read."""
    def sheet(name, *rows):
        grid = [("Date", "Price"), *rows]
        return [("w", name, r + 1, c + 1, v) for r, row in enumerate(grid) for c, v in enumerate(row)]
    years = [("w", "Y", 1, 1, "Year"), ("w", "Y", 1, 2, "Price"), ("w", "Y", 2, 1, "FY 24"), ("w", "Y", 2, 2, "3")]  # its labels are no dates
    data = years + sheet("A", ("2024-01-01", "#DIV/0!"), ("2024-01-02", "5"), ("2024-01-02", "5"), ("soon", "7")) + sheet("B", ("2024-01-01", "#DIV/0!")) + sheet("C", ("2024-01-01", "1"))
    columns = {"Price": ("price", "price")}
    specs = [R.SheetSpec("A", "long", columns=columns, tokens=("#DIV/0!",)), R.SheetSpec("B", "long", columns=columns), R.SheetSpec("C", "broken", columns=columns),
             R.SheetSpec("Y", "long", columns=columns, id_role="year")]

    def broken(cells, spec):
        raise ValueError("unreadable")
    monkeypatch.setitem(R.LAYOUTS, "broken", broken)
    status = job.refresh(spark, spark.createDataFrame(data, store.CELLS), specs, folder, "r1")
    assert status["status"] == "ok" and status["failed_sheets"] == 1
    a, b = (store.read_clean(spark, f"{folder}/clean", x).collect() for x in "AB")
    assert sorted((r["row_ref"], r["value"], r["text"]) for r in a if r["value"] is not None) == [(3, 5.0, None), (5, 7.0, None)]
    assert [(r["value"], r["text"]) for r in b] == [(None, "#DIV/0!")]
    log = spark.read.json(f"{folder}/cleaning_log")
    assert [(r["row_ref"], r["new_value"]) for r in log.where("action = 'duplicate_row_dropped'").collect()] == [(4, "row 3")]
    sheets = {r["sheet"]: (r["status"], r["newly_null_dates"]) for r in spark.read.parquet(f"{folder}/sheets").collect()}
    assert sheets == {"A": ("parsed", 1), "B": ("parsed", 0), "C": ("failed", 0), "Y": ("parsed", 0)}


def test_out_of_order_files_lose_nothing(spark, folder, rows):
    """Files whose events lie years apart, in no order, one per micro-batch, with a row delivered twice: default settings."""
    schema = "event_id long, ts timestamp, event_type string, value double"
    data = [(i, datetime(2024 - i % 3, 1 + i % 5, 1 + i % 4, i % 24), "ab"[i % 2], i + 0.123456) for i in range(60)]
    landing, out, last = f"{folder}/in", f"{folder}/out", f"{folder}/last"
    for part in (data[30:], data[:31], data[:1]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(landing)
    stream = lambda: live.file_stream(spark, landing, spark.read.parquet(landing).schema, files_per_batch=1)
    live.run_to_end(live.write_batches(stream(), last))
    once = live.without_repeats(spark, last, ["event_id"])
    assert sorted(r["event_id"] for r in once.collect()) == list(range(60))
    live.run_to_end(live.write_batches(stream(), out, lambda batch: live.period_parts(batch, "event_type")))
    got = rows(live.live_periods(spark, out), "series_id", "ts")
    batch = spark.createDataFrame(data + data[30:31] + data[:1], schema).groupBy(F.col("event_type").alias("series_id"), F.to_date("ts").alias("ts")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(38,10)")).cast("double").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))
    assert got == rows(batch, "series_id", "ts")


def test_results_keep_refreshes_and_gate_training(spark, folder, series, rows):
    df = series({"a": [1, 2]})
    for rid, v in (("r1", 1.0), ("r2", 2.0)):
        store.append_result(df.withColumn("value", F.lit(v)), f"{folder}/gold", rid)
    assert {r["value"] for r in rows(store.read_result(spark, f"{folder}/gold"))} == {2.0}
    state = f"{folder}/state"
    assert live.retrain_needed(spark, df, state)
    store.save_trained_through(spark, state, date(2020, 1, 2), "r1")
    assert not live.retrain_needed(spark, df, state) and live.retrain_needed(spark, df, state, force=True)
    assert live.retrain_needed(spark, series({"a": [1, 2, 3]}), state)
    assert store.read_forecast_log(spark, f"{folder}/nothing").count() == 0
    assert rows(live.touched(series({"a": [1], "b": [2]}), series({"b": [0]})))[0]["series_id"] == "b"


def test_one_failing_generator_does_not_hide_the_rest(spark, rows):
    notes = spark.createDataFrame([("s", "n")], "series_id string, note string")
    late = notes.withColumn("note", F.raise_error(F.lit("x" * 400)).cast("string"))  # fails in a task
    found, failed = I.generate_all({"good": lambda: I.data_quality(notes), "bad": lambda: 1 / 0, "late": lambda: I.data_quality(late)})
    assert found.count() == 1 and [f[0] for f in failed] == ["bad", "late"] and "x" * 400 in failed[1][1]
    every = I.with_failures(spark, found, failed).collect()
    assert [r["category"] for r in every] == ["Data quality", "bad", "late"] and every[2]["strength"] == "not available" and I.with_failures(spark, None, failed).count() == 2
    mixed = I.data_quality(notes).unionByName(I.finding(notes, "A", F.lit("h"), F.lit("d"), "strong")).unionByName(I.finding(notes, "B", F.lit("h"), F.lit("d"), "weak"))
    assert [r["strength"] for r in I.ranked(mixed).collect()] == ["strong", "weak", "data gap"] and I.highlights(mixed).count() == 1


def test_a_failing_module_leaves_its_status_and_the_other_results(spark, folder, series, rows):
    p = series({"a": [1, 2], "b": [3]})
    fail = {"on": True}
    steps = [runner.Module("sums", lambda t: t["p"].groupBy("series_id").agg(F.sum("value").alias("s")), ("p",)),
             runner.Module("in_a_task", lambda t: t["p"].withColumn("value", F.raise_error(F.lit("bad row"))) if fail["on"] else t["p"], ("p",)),
             runner.Module("planned_wrong", lambda t: t["p"].select("no_such_column"), ("p",)), runner.Module("needs_it", lambda t: t["in_a_task"], ("in_a_task",)),
             runner.Module("from_a_module", lambda t: t["sums"].where("s > 2"), ("sums",))]
    got = {r["module"]: (r["status"], r["rows"], r["reason"] or "") for r in rows(runner.run_modules(spark, steps, {"p": p}, folder, "r1"))}
    assert got["sums"] == ("ok", 2, "") and got["from_a_module"] == ("ok", 2, "") and got["needs_it"] == ("skipped", None, "needs in_a_task")
    assert got["in_a_task"][0] == "failed" and "bad row" in got["in_a_task"][2] and got["planned_wrong"][0] == "failed" and "no_such_column" in got["planned_wrong"][2]
    assert store.read_result(spark, f"{folder}/sums").count() == 2 and store.finished(spark, f"{folder}/in_a_task") == []
    fail["on"] = False
    again = {r["module"]: r["status"] for r in rows(runner.run_modules(spark, steps, {"p": p}, folder, "r1"))}
    assert again["needs_it"] == "ok" and spark.read.parquet(f"{folder}/module_runs").count() == 5
