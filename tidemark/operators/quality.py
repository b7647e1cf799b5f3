"""Cleaning, validation and coverage.  Checks observe and report; cleaning only applies what is certain and logs it."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.config import GATES
from tidemark.functions import coerce
from tidemark.operators import windows as W
from tidemark.operators.series import small_table

ROW = ["source", "sheet", "row_ref"]


def _is_token(text: Column, tokens, by_sheet: dict | None = None) -> Column:
    """Whether a text means "no observation": one of the tokens, or of those ``by_sheet`` adds for its own sheet."""
    known = (text == "") | F.lower(text).isin([t.lower() for t in tokens])
    for sheet, more in (by_sheet or {}).items():
        known = known | ((F.col("sheet") == sheet) & F.lower(text).isin([t.lower() for t in more]))
    return known


def sheet_tokens(specs) -> dict:
    """The tokens that sheets add to the common ones."""
    return {s.sheet: s.tokens for s in specs if s.tokens}


def cleaned(obs: DataFrame, tokens=tuple(fixed.MISSING_TOKENS), by_sheet: dict | None = None) -> DataFrame:
    """Each raw cell as value or text, with the action taken and the original kept beside it.

    Order: a known token becomes missing, a numeric text a number, anything else is only trimmed.
    """
    text = F.trim("raw")
    number = coerce.numeric_text("raw")
    token = _is_token(text, tokens, by_sheet)
    action = (F.when(F.col("raw").isNull(), None).when(token, "token_to_null").when(number.isNotNull(), "numeric_string_converted")
              .when(text != F.col("raw"), "trimmed_whitespace"))
    return (obs.withColumn("value", F.when(~token, number)).withColumn("text", F.when(~token & number.isNull(), text)).withColumn("action", action))


def cleaning_log(clean: DataFrame) -> DataFrame:
    """Every change with what stood there before."""
    changed = clean.where(F.col("action").isNotNull())
    new = F.coalesce(F.col("value").cast("string"), F.col("text"))
    return changed.select(*ROW, "metric", "action", F.col("raw").alias("original_value"), new.alias("new_value"))


def with_days(rows: DataFrame, raw: str = "id", out: str = "ts") -> DataFrame:
    return rows.withColumn(out, coerce.to_day(raw)).withColumn("bad_date", F.col(raw).isNotNull() & F.col(out).isNull())


def without_blank_rows(clean: DataFrame) -> DataFrame:
    """Rows of a sheet with nothing in any column are dropped; only for layouts where a row is one record."""
    n = F.count(F.coalesce(F.col("value").cast("string"), F.col("text"))).over(Window.partitionBy(*ROW))
    return clean.withColumn("_n", n).where("_n > 0").drop("_n")


def without_duplicate_rows(clean: DataFrame):
    """(kept, dropped): of a sheet's rows equal in every cell the first stays; one row of the log per row dropped.

    A row's content is one checksum over its cells, of which a spreadsheet's width bounds the number; the first of equal rows is
    an aggregate combined before its shuffle, so a row repeated very often piles up nowhere.
    """
    cell = F.struct("id", "group_key", "metric", "value", "text")
    content = clean.groupBy(*ROW).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(cell))), 256).alias("_content"))
    first = content.groupBy("source", "sheet", "_content").agg(F.min("row_ref").alias("row_ref"))
    kept = first.select(*ROW)
    gone = content.join(kept, ROW, "left_anti").join(first.withColumnRenamed("row_ref", "first_row"), ["source", "sheet", "_content"])
    log = gone.select(*ROW, F.lit(None).cast("string").alias("metric"), F.lit("duplicate_row_dropped").alias("action"), F.lit(None).cast("string").alias("original_value"),
                      F.concat(F.lit("row "), "first_row").alias("new_value"))
    return clean.join(kept, ROW, "left_semi"), log


def newly_null_dates(obs: DataFrame, sheets) -> DataFrame:
    """Rows per sheet whose label is no date although it should be one.  ``sheets`` names those that promise dates; a sheet of years,
    categories or plain ids has none to lose."""
    rows = obs.where(F.col("sheet").isin(list(sheets)) & F.col("id").isNotNull() & F.col("ts").isNull()).select(*ROW).distinct()
    return rows.groupBy("source", "sheet").agg(F.count(F.lit(1)).alias("newly_null_dates"))


def scan_values(obs: DataFrame, tokens=tuple(fixed.MISSING_TOKENS), keys=("source", "sheet", "metric", "role"), by_sheet: dict | None = None) -> DataFrame:
    """Missing, text contamination and forbidden negatives per column, one map-side combined aggregate."""
    text, number = F.trim("raw"), coerce.numeric_text("raw")
    missing = F.col("raw").isNull() | _is_token(text, tokens, by_sheet)
    negative = (number < 0) & F.col("role").isin(fixed.NON_NEGATIVE_ROLES)
    return obs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(missing).alias("missing"), F.count_if(~missing & number.isNull()).alias("text_contamination"),
        F.count_if(F.coalesce(negative, F.lit(False))).alias("negative_values"), F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"),
        F.count_if("is_estimate").alias("estimate_rows"))


def offenders(obs: DataFrame, tokens=tuple(fixed.MISSING_TOKENS), by_sheet: dict | None = None) -> DataFrame:
    """The cells behind the counts of ``scan_values``."""
    text, number = F.trim("raw"), coerce.numeric_text("raw")
    bad_text = F.col("raw").isNotNull() & ~_is_token(text, tokens, by_sheet) & number.isNull()
    negative = (number < 0) & F.col("role").isin(fixed.NON_NEGATIVE_ROLES)
    issue = F.when(bad_text, "text_contamination").when(negative, "negative_value")
    return obs.withColumn("issue", issue).where(F.col("issue").isNotNull()).select(*ROW, "metric", "issue", "raw")


def duplicates(rows: DataFrame, key: list, per: list) -> DataFrame:
    """Rows that share their key with another row, every member counted."""
    sizes = rows.groupBy(*per, *[k for k in key if k not in per]).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.groupBy(*per).agg(F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("duplicate_rows"))


def validation_report(obs: DataFrame, tokens=tuple(fixed.MISSING_TOKENS), by_sheet: dict | None = None) -> DataFrame:
    """Per column issue counts next to the sheet's duplicate keys."""
    keyed = duplicates(obs, ["source", "sheet", "id", "group_key", "metric"], ["source", "sheet"])
    return scan_values(obs, tokens, by_sheet=by_sheet).join(keyed, ["source", "sheet"])


def issue_totals(report: DataFrame) -> DataFrame:
    """Summary over all sheets; a sheet's duplicates count once, not once per column."""
    per_sheet = report.groupBy("source", "sheet").agg(
        F.sum(F.col("missing") + F.col("text_contamination") + F.col("negative_values")).alias("_i"), F.max("duplicate_rows").alias("_d"))
    return per_sheet.agg(F.count(F.lit(1)).alias("sheets_validated"), F.sum(F.col("_i") + F.col("_d")).alias("total_issues"))


def coverage_table(series: DataFrame, expected) -> DataFrame:
    """Rows, span and status of every expected dataset, found or not."""
    spec = small_table(series.sparkSession, "series_id string", [(e,) for e in expected])
    found = series.where(F.col("value").isNotNull()).groupBy("series_id").agg(
        F.count("value").alias("rows"), F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"))
    return spec.join(found, "series_id", "left").select(
        "series_id", F.coalesce("rows", F.lit(0)).alias("rows"), "from_ts", "to_ts",
        F.when(F.col("rows").isNull(), "data not available").otherwise("OK").alias("status"))


def quality_notes(series: DataFrame, min_days: int = GATES.gap_days) -> DataFrame:
    """One note per series with coverage gaps: how many, and the longest."""
    gaps = W.coverage_gaps(series, min_days)
    worst = F.max_by(F.struct("from_ts", "to_ts"), F.struct(F.col("days"), F.col("from_ts")))
    out = gaps.groupBy("series_id").agg(F.count(F.lit(1)).alias("gaps"), F.max("days").alias("longest_days"), worst.alias("_w"))
    note = F.format_string("%s: %d coverage gap(s) over %d days; the largest spans %d days (%s to %s)", F.col("series_id"), F.col("gaps"),
                           F.lit(min_days), F.col("longest_days"), F.col("_w.from_ts").cast("string"), F.col("_w.to_ts").cast("string"))
    return out.select("series_id", "gaps", "longest_days", note.alias("note"))


def full_span(series: DataFrame) -> DataFrame:
    return series.where(F.col("value").isNotNull()).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("latest_ts"), F.count_distinct("series_id").alias("series"))


def column_profile(table: DataFrame, name: str) -> DataFrame:
    """Type, role, filled share and range of every column of a table, from one pass over it."""
    def stats(c):
        text = F.col(c).cast("string")
        return F.struct(F.lit(c).alias("column"), F.count(c).alias("non_null"), F.min(text).alias("minimum"), F.max(text).alias("maximum"))
    skip = ("array", "map", "struct")
    cols = [c for c, t in table.dtypes if not t.startswith(skip)]
    types = F.create_map(*[F.lit(x) for c, t in table.dtypes for x in (c, t)])
    flat = table.agg(F.count(F.lit(1)).alias("rows"), F.array(*[stats(c) for c in cols]).alias("_a")).select("rows", F.explode("_a").alias("_x"))
    return flat.select(F.lit(name).alias("dataset"), F.col("_x.column").alias("column"), F.try_element_at(types, F.col("_x.column")).alias("type"),
                       coerce.column_role("_x.column").alias("role"), "rows", F.col("_x.non_null").alias("non_null"), F.col("_x.minimum").alias("minimum"),
                       F.col("_x.maximum").alias("maximum"))


def reconcile(recomputed: DataFrame, supplied: DataFrame, keys: list, value: str) -> DataFrame:
    """Recomputed against supplied figures, labels compared without regard to case."""
    def folded(df, out):
        return df.select(*[F.lower(F.trim(k)).alias(k) for k in keys], F.col(value).alias(out))
    both = folded(recomputed, "recomputed").join(folded(supplied, "supplied"), keys)
    return both.withColumn("difference", F.col("recomputed") - F.col("supplied"))


def reconcile_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.percentile(F.abs("difference"), 0.5).alias("median_abs_difference"), F.max(F.abs("difference")).alias("max_abs_difference"),
                    F.count(F.lit(1)).alias("n"))
