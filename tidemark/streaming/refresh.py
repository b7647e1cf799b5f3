"""One refresh: parse, validate, clean, persist, report.  It returns a status instead of raising."""

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import quality, reshape
from tidemark.operators.series import small_table
from tidemark.sources import store
from tidemark.streaming import live


def refresh_id() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")


def refresh(spark: SparkSession, cells: DataFrame, specs, base: str, rid: str | None = None, then=()) -> dict:
    """Rebuild the tiers under ``base`` from landed cells and run the follow-up steps (analytics, forecasts).

    Everything is written under the refresh id, so a refresh repeated after a failure replaces what it left.

    ``then`` holds (name, function(spark, base, rid)).  A failing step is reported by name and the others still run.
    """
    rid = rid or refresh_id()
    status = {"refresh_id": rid, "status": "ok"}
    failed = []
    try:
        parts = [reshape.parse(cells, [x for x in specs if x.layout in reshape.NATIVE])]
        for spec in specs:
            if spec.layout in reshape.LAYOUTS and spec.layout not in reshape.NATIVE:
                try:  # a sheet with a parser of its own is read apart: a bad one must not keep the others from being read
                    parts.append(store.landed(reshape.parse(cells, [spec])))
                except Exception as error:
                    failed.append((spec.sheet, f"failed: {type(error).__name__}: {error}"))
        # one write of all sheets: readers never see the raw tier without them
        store.write_tier(reduce(DataFrame.unionByName, parts), f"{base}/raw", rid, None)
        obs = spark.read.schema(reshape.OBS_SCHEMA).parquet(f"{base}/raw/refresh_id={rid}")
        tokens = quality.sheet_tokens(specs)
        store.append_result(quality.validation_report(obs, by_sheet=tokens), f"{base}/quality", rid)
        clean = quality.cleaned(obs, by_sheet=tokens)
        rowwise = [s.sheet for s in specs if s.layout in ("long", "sparse_tracker")]
        kept, dropped = quality.without_duplicate_rows(quality.without_blank_rows(clean.where(F.col("sheet").isin(rowwise))))
        store.write_tier(kept.unionByName(clean.where(~F.col("sheet").isin(rowwise))), f"{base}/clean", rid)
        store.append_json(quality.cleaning_log(clean).unionByName(dropped), f"{base}/cleaning_log", rid)
        lost = quality.newly_null_dates(obs, [x.sheet for x in specs if reshape.promises_dates(x)]).groupBy("sheet").agg(F.sum("newly_null_dates").alias("newly_null_dates"))
        broken = small_table(spark, "sheet string, _failure string", failed)
        sheets = reshape.sheet_status(cells, specs).join(lost, "sheet", "left").join(broken, "sheet", "left")
        sheets = sheets.withColumns({"newly_null_dates": F.coalesce("newly_null_dates", F.lit(0)), "reason": F.coalesce("_failure", "reason"),
                                     "status": F.when(F.col("_failure").isNotNull(), "failed").otherwise(F.col("status"))}).drop("_failure")
        store.append_result(sheets, f"{base}/sheets", rid)
        totals = quality.issue_totals(spark.read.parquet(f"{base}/quality/refresh_id={rid}")).first()
        status.update(sheets_validated=totals["sheets_validated"], total_issues=totals["total_issues"] or 0, failed_sheets=len(failed))
        if failed and not totals["sheets_validated"]:
            return {**status, "status": "failed", "error": "; ".join(f"{sheet}: {why}" for sheet, why in failed)}
    except Exception as error:  # a watching process must outlive one bad delivery
        return {**status, "status": "failed", "error": f"{type(error).__name__}: {error}"}
    for name, step in then:
        try:
            step(spark, base, rid)
            status[name] = "ok"
        except Exception as error:
            status[name] = f"failed: {error}"
    return status


def watch(spark: SparkSession, landing: str, specs, base: str, interval: str | None = None, then=()):
    """Refresh whenever new cell files land: once over what is there, or every interval."""
    def on_batch(batch: DataFrame, batch_id: int):
        new = batch.select("source", "sheet").distinct()
        whole = store.read_cells(spark, landing)
        if not new.isEmpty():
            status = refresh(spark, whole, specs, base, f"batch{batch_id:08d}", then)
            rows = [(name, outcome, status.get("error") if name == "refresh" else None) for name, outcome in
                    [("refresh", status["status"])] + [(name, status[name]) for name, _ in then if name in status]]
            store.append_json(spark.createDataFrame(rows, "step string, status string, error string"), f"{base}/refreshes", status["refresh_id"])
    stream = live.file_stream(spark, landing, store.CELLS, nested=True)
    return stream.writeStream.option("checkpointLocation", f"{base}/watch").foreachBatch(on_batch).trigger(**live.trigger(interval)).start()
