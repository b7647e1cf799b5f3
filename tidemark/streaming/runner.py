"""A run over analysis modules: each lands its own result, a failure stays with its module."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.series import small_table
from tidemark.sources import store

STATUS = "module string, status string, reason string, rows bigint"


@dataclass(frozen=True)
class Module:
    """``build`` makes the result from the tables it needs by name: inputs of the run or results of earlier modules."""

    name: str
    build: Callable[[dict], DataFrame]
    needs: tuple = ()


def run_modules(spark: SparkSession, modules, inputs: dict, base: str, rid: str) -> DataFrame:
    """Run the modules in their order and return a status row for each: module, status, reason, rows.

    A result is computed and written below ``base``/module inside the module's own ``try``, so an error in a task counts as
    the module's failure as one while planning does.  A module whose needs are missing or failed is skipped with their names.  The status
    is written to ``base``/module_runs; a repeated run under the same id replaces its results and its status.
    """
    tables, rows = dict(inputs), []
    for m in modules:
        missing = [n for n in m.needs if n not in tables]
        if missing:
            rows.append((m.name, "skipped", "needs " + ", ".join(missing), None))
            continue
        try:
            path = f"{base}/{m.name}"
            store.append_result(m.build({n: tables[n] for n in m.needs}), path, rid)
            result = spark.read.parquet(f"{path}/refresh_id={rid}")
            rows.append((m.name, "ok", None, result.count()))
            tables[m.name] = result
        except Exception as error:  # one module must not keep the others from their results
            rows.append((m.name, "failed", f"{type(error).__name__}: {error}", None))
    status = small_table(spark, STATUS, rows)
    store.append_result(status, f"{base}/module_runs", rid)
    return spark.read.schema(STATUS).parquet(f"{base}/module_runs/refresh_id={rid}")
