"""Landed grids to tidy observations.

``cells(source, sheet, r, c, v)`` holds the used range of every sheet of every file, blank cells with a null ``v``.
All configured sheets are parsed in one pass, whatever their layouts: the columns of a sheet's header become a small table that says
what each column holds, body cells meet it, and a window along the row, whose width a spreadsheet bounds, gives them their row label.  A sheet
holding a third of all cells is spread over its rows; the columns are broadcast while they are few, else adaptive execution
splits what one column has too much of.
"""

import json

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import coerce
from tidemark.operators.series import small_table

SHEET = ["source", "sheet"]
OBS = ["source", "sheet", "row_ref", "id", "ts", "group_key", "metric", "role", "year_label", "is_estimate", "raw"]
OBS_SCHEMA = ("source string, sheet string, row_ref bigint, id string, ts date, group_key string, metric string, role string, year_label string, "
              "is_estimate boolean, raw string")


@dataclass(frozen=True)
class SheetSpec:
    """How one sheet is laid out.  ``columns`` maps a header text to (name, role)."""

    sheet: str
    layout: str
    id_col: int = 1
    header_row: int = 1
    metric_row: int | None = None
    data_start: int = 2
    max_col: int | None = None
    id_role: str = "date"
    value_name: str = "value"
    value_role: str = "unknown"
    columns: dict = field(default_factory=dict)
    overrides: dict = field(default_factory=dict)
    estimate_labels: tuple = ()
    filters: tuple = ()
    year_column: str = "Year"
    month_column: str = "Month"
    tokens: tuple = ()
    reason: str = ""


def _has(c="v") -> Column:
    return F.col(c).isNotNull() & (F.trim(F.col(c)) != "")


def header_cells(cells: DataFrame, row: int, name: str = "label") -> DataFrame:
    return cells.where((F.col("r") == row) & _has()).select(*SHEET, "c", F.trim("v").alias(name))


def filled_header(cells: DataFrame, row: int, name: str = "group_key") -> DataFrame:
    """A merged header row with its label repeated over the columns it spans."""
    along = Window.partitionBy(*SHEET).orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    text = F.when(_has(), F.trim("v"))
    return cells.where(F.col("r") == row).select(*SHEET, "c", F.last(text, ignorenulls=True).over(along).alias(name)).where(
        F.col(name).isNotNull())


def row_labels(cells: DataFrame, spec: SheetSpec) -> DataFrame:
    return cells.where((F.col("c") == spec.id_col) & (F.col("r") >= spec.data_start) & _has()).select(*SHEET, "r", F.trim("v").alias("id"))


def body(cells: DataFrame, spec: SheetSpec) -> DataFrame:
    inside = (F.col("r") >= spec.data_start) & (F.col("c") != spec.id_col)
    return cells.where(inside & (F.col("c") <= spec.max_col) if spec.max_col else inside).select(*SHEET, "r", "c", F.col("v").alias("raw"))


def unpivot(cells: DataFrame, spec: SheetSpec) -> DataFrame:
    """Body cells with their row label and column header."""
    return (body(cells, spec).join(header_cells(cells, spec.header_row), SHEET + ["c"])
            .join(row_labels(cells, spec), SHEET + ["r"]))


def first_gap(labels: DataFrame) -> DataFrame:
    """Row at which the labels of a sheet (r, k, start) first stop, found by an anti-join on the next row."""
    keys = [*SHEET, "k"]
    ends = labels.join(labels.select(*keys, (F.col("r") - 1).alias("r")), [*keys, "r"], "left_anti").where(F.col("r") >= F.col("start"))
    return ends.groupBy(*keys).agg((F.min("r") + 1).alias("stop_row"))


_NAMED = "struct<name:string,role:string,group:string>"
_SPEC = (f"layout string, id_col int, header_row int, metric_row int, data_start int, max_col int, id_role string, value_name string, value_role string, year_column string, "
         f"month_column string, filters array<string>, estimates array<string>, columns map<string,{_NAMED}>, overrides map<string,{_NAMED}>")
NATIVE = ("long", "wide_pivot_year_month", "wide_pivot_year_cols", "wide_pivot_merged_header", "sparse_tracker")


def promises_dates(spec: SheetSpec) -> bool:
    """Whether every row of a sheet has to have a date."""
    return spec.layout in ("wide_pivot_year_month", "sparse_tracker") or spec.layout in ("long", "wide_pivot_merged_header") and spec.id_role == "date"


def spec_table(spark, specs) -> DataFrame:
    """Specs as rows: sheet, ``k`` (its number) and ``s``, a struct of its layout; an inline table, whose size the optimiser knows."""
    def row(x):
        named = {h.strip().lower(): {"name": n, "role": ro} for h, (n, ro) in x.columns.items()}
        over = {str(c): {"name": n, "role": ro, "group": g} for c, (n, ro, g) in x.overrides.items()}
        return json.dumps({"layout": x.layout, "id_col": x.id_col, "header_row": x.header_row, "metric_row": x.metric_row or x.header_row, "data_start": x.data_start, "max_col": x.max_col,
                           "id_role": x.id_role, "value_name": x.value_name, "value_role": x.value_role, "year_column": x.year_column.lower(), "month_column": x.month_column.lower(),
                           "filters": list(x.filters), "estimates": list(x.estimate_labels), "columns": named, "overrides": over})
    rows = small_table(spark, "sheet string, k int, spec string", [(x.sheet, k, row(x)) for k, x in enumerate(specs)])
    return rows.select("sheet", "k", F.from_json("spec", _SPEC).alias("s"))


def _columns(placed: DataFrame) -> DataFrame:
    """What each column of a sheet holds by its header: label, group_key, metric, role, is_estimate and whether it is read (``used``)."""
    along = Window.partitionBy(*SHEET, "k", "r").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    text = F.when(_has(), F.trim("v"))
    rows = placed.where((F.col("r") == F.col("s.header_row")) | (F.col("r") == F.col("s.metric_row")))
    filled = rows.select(*SHEET, "k", "s", "r", "c", text.alias("t"), F.last(text, ignorenulls=True).over(along).alias("fill"))
    of = lambda row, value: F.max(F.when(F.col("r") == F.col(f"s.{row}"), F.col(value)))
    heads = filled.groupBy(*SHEET, "k", "c").agg(of("header_row", "t").alias("label"), of("header_row", "fill").alias("grp"), of("metric_row", "fill").alias("low"), F.any_value("s").alias("s"))
    layout = F.col("s.layout")
    merged, pivot = layout == "wide_pivot_merged_header", layout.isin("wide_pivot_year_month", "wide_pivot_year_cols")
    header = F.when(merged, F.trim("low")).otherwise(F.col("label"))
    named = F.coalesce(F.try_element_at("s.columns", F.lower(header)), F.try_element_at("s.columns", F.lower(coerce.without_unit_clause(header))))
    heads = heads.withColumns({"n": named, "o": F.when(merged, F.try_element_at("s.overrides", F.col("c").cast("string")))})
    used = F.when(merged, F.coalesce("grp", "low").isNotNull()).when(pivot, F.col("label").isNotNull()).otherwise(F.col("n").isNotNull())
    inside = ((layout == "sparse_tracker") | (F.col("c") != F.col("s.id_col"))) & (F.col("s.max_col").isNull() | (F.col("c") <= F.col("s.max_col")))
    is_estimate = F.when(merged, F.col("o").isNull() & F.array_contains("s.estimates", F.col("grp"))).when(layout == "wide_pivot_year_cols", F.array_contains("s.estimates", F.col("label")))
    return heads.select(
        *SHEET, "k", "c", "label", (used & inside).alias("used"), F.when(merged, F.when(F.col("o").isNotNull(), F.col("o.group")).otherwise(F.col("grp"))).alias("group_key"),
        F.when(merged, F.coalesce("o.name", "n.name", F.trim("low"), "grp")).when(pivot, F.col("s.value_name")).otherwise(F.col("n.name")).alias("metric"),
        F.when(merged, F.coalesce("o.role", "n.role", F.lit("unknown"))).when(pivot, F.col("s.value_role")).otherwise(F.col("n.role")).alias("role"), F.coalesce(is_estimate, F.lit(False)).alias("is_estimate"))


def parse_tagged(cells: DataFrame, specs) -> DataFrame:
    """Body cells of the sheets that ``specs`` lay out, as observations with a ``tag``: observation, or what a filter of the sheet's spec sets
    apart: ``total`` (a supplied total row), ``legend`` (a label that is no year) or ``below`` (what follows the first gap).

    A header is matched as it stands, else without its unit clause.  Years whose label marks them as projected are estimates.  A sheet
    with several specs is parsed by each; other layouts, and sheets without a spec, give no rows.
    """
    known = [x for x in specs if x.layout in NATIVE]
    layouts = {x.layout for x in known}

    def laid_out(*names):
        """Whether the sheet has one of these layouts; decided here where all specs agree."""
        if layouts <= set(names):
            return F.lit(True)
        return F.col("layout").isin(list(names)) if layouts & set(names) else F.lit(False)
    table = spec_table(cells.sparkSession, known)
    placed = cells.join(table, "sheet")
    columns = _columns(placed)
    asked = {f: F.array_contains("s.filters", F.lit(f)).alias(f) for f in ("stop_at_blank_id", "id_is_4digit_year", "exclude_total_row")}
    body = placed.where(F.col("r") >= F.col("s.data_start")).select(*SHEET, "k", "r", "c", "v", "s.layout", "s.id_col", "s.id_role", "s.data_start", "s.year_column", "s.month_column", *asked.values())
    body = body.join(columns, [*SHEET, "k", "c"], "left")
    tracker, pivot, by_month = laid_out("sparse_tracker"), laid_out("wide_pivot_year_month", "wide_pivot_year_cols"), laid_out("wide_pivot_year_month")
    row = Window.partitionBy(*SHEET, "k", "r")
    filled = lambda here: F.max(F.when(here & _has(), F.trim("v"))).over(row)
    body = body.withColumns({"_id": F.when(~tracker, filled(F.col("c") == F.col("id_col"))), "_y": F.when(tracker, filled(F.lower("label") == F.col("year_column"))),
                             "_m": F.when(tracker, filled(F.lower("label") == F.col("month_column")))})
    body = body.where(F.coalesce("_id", "_y", "_m").isNotNull())
    tag = F.when(F.col("exclude_total_row") & (F.lower("_id") == "total"), "total").when(F.col("id_is_4digit_year") & ~F.coalesce(F.col("_id").try_cast("int").between(1900, 2100), F.lit(False)), "legend")
    if any("stop_at_blank_id" in x.filters for x in known):
        ids = placed.where(F.array_contains("s.filters", F.lit("stop_at_blank_id")) & (F.col("c") == F.col("s.id_col")) & (F.col("r") >= F.col("s.data_start")) & _has())
        body = body.join(first_gap(ids.select(*SHEET, "k", "r", F.col("s.data_start").alias("start"))), [*SHEET, "k"], "left")
        tag = F.when(F.col("stop_at_blank_id") & F.coalesce(F.col("r") >= F.col("stop_row"), F.lit(True)), "below").otherwise(tag)
    body = body.where("used").withColumn("tag", F.coalesce(F.when(by_month, tag), F.lit("observation")))
    by_id = F.col("id_role") == "year"
    year = F.when(tracker, F.col("_y")).when(by_month & by_id, F.col("_id")).when(pivot, F.col("label"))
    month = F.when(tracker, F.col("_m")).when(by_id, F.col("label")).otherwise(F.col("_id"))
    ts = F.when(laid_out("long", "wide_pivot_merged_header"), F.when(F.col("id_role") == "date", coerce.to_day("_id"))).when(tracker | by_month, coerce.month_start(year.try_cast("int"), coerce.parse_month(month)))
    return body.select(*SHEET, F.col("r").cast("bigint").alias("row_ref"), F.when(tracker, F.concat_ws(" ", "_y", "_m")).otherwise(F.col("_id")).alias("id"), ts.alias("ts"),
                       F.when(laid_out("wide_pivot_year_cols"), F.col("_id")).otherwise(F.col("group_key")).alias("group_key"), "metric", "role", year.alias("year_label"),
                       F.when(by_month, F.coalesce(coerce.is_projection_label(year), F.lit(False))).otherwise(F.col("is_estimate")).alias("is_estimate"), F.col("v").alias("raw"), "tag")


def parse(cells: DataFrame, specs) -> DataFrame:
    """Every configured sheet of every source as one observation table.  Layouts added to ``LAYOUTS`` are parsed by their own functions."""
    out = parse_tagged(cells, specs).where("tag = 'observation'").select(*OBS)
    for x in specs:
        if x.layout not in NATIVE and x.layout in LAYOUTS:
            out = out.unionByName(LAYOUTS[x.layout](cells.where(F.col("sheet") == x.sheet), x))
    return out


def _one_sheet(layout: str):
    def parsed(cells: DataFrame, spec: SheetSpec) -> DataFrame:
        return parse(cells, [replace(spec, layout=layout)])
    parsed.__doc__ = f"The sheet of one spec, laid out as {layout}."
    return parsed


#: Parsers by layout: of one row per id under named columns, year by month in either orientation, category by year, two header rows
#: (group over metric), year and month columns next to sparse values.
LAYOUTS = {layout: _one_sheet(layout) for layout in NATIVE}
parse_long, parse_year_month, parse_year_columns, parse_merged_header, parse_tracker = (LAYOUTS[layout] for layout in NATIVE)


def sheet_status(cells: DataFrame, specs) -> DataFrame:
    """Each configured or found sheet with what happened to it: parsed, skipped with a reason, or unconfigured."""
    rows = [(s.sheet, s.layout, s.reason or "derived sheet, not read as a source") for s in specs]
    spec = small_table(cells.sparkSession, "sheet string, layout string, _why string", rows)
    found = cells.groupBy("sheet").agg(F.count_distinct("source").alias("sources"))
    both = found.join(spec, "sheet", "full")
    status = (F.when(F.col("layout").isNull(), "unconfigured").when(F.col("sources").isNull(), "skipped")
              .when(F.col("layout").isin(list(LAYOUTS)), "parsed").otherwise("skipped"))
    reason = (F.when(F.col("layout").isNull(), "no configuration").when(F.col("sources").isNull(), "configured but not found")
              .when(F.col("layout") == "derived_skip", F.col("_why")).when(~F.col("layout").isin(list(LAYOUTS)), F.concat(F.lit("unknown layout "), "layout")))
    return both.select("sheet", "layout", F.coalesce("sources", F.lit(0)).alias("sources"), status.alias("status"), reason.alias("reason"))


def widen(obs: DataFrame, metrics, value: str = "value") -> DataFrame:
    """Metrics side by side for one row of a sheet; the last cell wins."""
    return obs.groupBy("source", "sheet", "ts", "group_key").pivot("metric", list(metrics)).agg(F.max_by(value, "row_ref"))


def numbered_roles(headers: DataFrame) -> DataFrame:
    """Column roles of a sheet, repeated ones numbered from the left (arrivals, arrivals_2)."""
    nth = F.row_number().over(Window.partitionBy(*SHEET, "role").orderBy("c"))
    return (headers.withColumn("role", coerce.column_role("label")).withColumn("_n", nth)
            .withColumn("name", F.when(F.col("_n") > 1, F.concat_ws("_", "role", "_n")).otherwise(F.col("role"))).drop("_n"))


def trimmed(cells: DataFrame) -> DataFrame:
    """Without the empty rows and columns after the last filled ones."""
    reach = cells.where(_has()).groupBy(*SHEET).agg(F.max("r").alias("_r"), F.max("c").alias("_c"))
    return cells.join(reach, SHEET).where((F.col("r") <= F.col("_r")) & (F.col("c") <= F.col("_c"))).drop("_r", "_c")


def stacked_blocks(cells: DataFrame, id_col: int = 1, marker: str = "months") -> DataFrame:
    """Month by year blocks stacked in one sheet: (block, ts, value).

    A block starts at each row whose label is the marker.  The starts of a sheet are few, so each row finds its
    block by a bounded list instead of a running sum over the whole sheet.
    """
    starts = cells.where((F.col("c") == id_col) & F.lower(F.trim("v")).startswith(marker)).groupBy(*SHEET).agg(
        F.array_sort(F.collect_set("r")).alias("_starts"))
    placed = cells.join(starts, SHEET).withColumn("block", F.size(F.filter("_starts", lambda s: s <= F.col("r")))).where("block > 0")
    placed = placed.withColumn("_top", F.element_at("_starts", F.col("block")))
    heads = placed.where((F.col("r") == F.col("_top")) & (F.col("c") != id_col)).select(*SHEET, "block", "c", coerce.parse_year("v").alias("year"))
    labels = placed.where((F.col("c") == id_col) & (F.col("r") > F.col("_top"))).select(*SHEET, "r", coerce.parse_month("v").alias("month"))
    rows = placed.where((F.col("r") > F.col("_top")) & (F.col("c") != id_col)).join(heads, SHEET + ["block", "c"]).join(labels, SHEET + ["r"])
    return rows.select(*SHEET, "block", coerce.month_start("year", "month").alias("ts"), coerce.to_number("v").alias("value")).where(
        F.col("ts").isNotNull() & F.col("value").isNotNull())


def block_ratio(blocks: DataFrame) -> DataFrame:
    """Median ratio of the second block to the first and whether it is the same everywhere."""
    both = blocks.where("block in (1, 2)").groupBy(*SHEET, "ts").agg(
        F.max(F.when(F.col("block") == 1, F.col("value"))).alias("_a"), F.max(F.when(F.col("block") == 2, F.col("value"))).alias("_b"))
    ratios = both.where(F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("_a") != 0)).withColumn("_q", F.col("_b") / F.col("_a"))
    med = ratios.groupBy(*SHEET).agg(F.percentile("_q", 0.5).alias("ratio"))
    same = F.bool_and(F.abs(F.col("_q") - F.col("ratio")) <= 1e-8 + 1e-6 * F.abs("ratio"))
    return ratios.join(med, SHEET).groupBy(*SHEET, "ratio").agg(same.alias("constant"), F.count(F.lit(1)).alias("n"))


def particulars_by_year(cells: DataFrame, id_col: int = 1) -> DataFrame:
    """Line items by year; the header is the first row with three or more years."""
    years = cells.withColumn("_y", F.when(F.col("c") != id_col, coerce.parse_year("v")))
    top = years.groupBy(*SHEET, "r").agg(F.count("_y").alias("_n")).where("_n >= 3").groupBy(*SHEET).agg(F.min("r").alias("_top"))
    placed = years.join(top, SHEET)
    heads = placed.where((F.col("r") == F.col("_top")) & F.col("_y").isNotNull()).select(
        *SHEET, "c", F.col("_y").alias("year"), coerce.is_projection_label("v").alias("is_estimate"))
    labels = placed.where((F.col("r") > F.col("_top")) & (F.col("c") == id_col) & _has()).select(*SHEET, "r", coerce.cell_text("v").alias("item"))
    return (placed.where((F.col("r") > F.col("_top")) & (F.col("c") != id_col)).join(heads, SHEET + ["c"]).join(labels, SHEET + ["r"])
            .select(*SHEET, "r", "item", "year", "is_estimate", coerce.to_number("v").alias("value")))


def state_year_metrics(cells: DataFrame, header_row: int = 1, metric_row: int = 2, id_col: int = 1) -> DataFrame:
    """State by (year over area / production / yield) to one row per state and year."""
    year = filled_header(cells, header_row, "_h").withColumn("year", coerce.parse_year("_h")).where("year is not null")
    text = coerce.tidy_text("label")
    metric = F.when(text.contains("area"), "area").when(text.contains("prod"), "production").when(text.contains("yield"), "yield")
    heads = year.join(header_cells(cells, metric_row), SHEET + ["c"]).withColumn("metric", metric).where("metric is not null")
    labels = cells.where((F.col("c") == id_col) & (F.col("r") > metric_row) & _has()).select(*SHEET, "r", coerce.cell_text("v").alias("state"))
    rows = cells.where(F.col("r") > metric_row).join(heads, SHEET + ["c"]).join(labels, SHEET + ["r"])
    return rows.groupBy(*SHEET, "state", "year").pivot("metric", ["area", "production", "yield"]).agg(F.avg(coerce.to_number("v")))


def national_row(table: DataFrame, marker: str = "india") -> DataFrame:
    """The national rows where a sheet has them, else all states."""
    flag = coerce.tidy_text("state").contains(marker)
    any_national = table.where(flag).select(*SHEET).distinct().withColumn("_nat", F.lit(True))
    return table.join(any_national, SHEET, "left").where(F.col("_nat").isNull() | flag).drop("_nat")


def square_matrix(cells: DataFrame, header_row: int = 1, id_col: int = 1) -> DataFrame:
    """Labelled square matrix to (row, col, value)."""
    spec = SheetSpec("", "square", id_col=id_col, header_row=header_row, data_start=header_row + 1)
    return unpivot(cells, spec).select(*SHEET, F.col("id").alias("row_label"), F.col("label").alias("col_label"), coerce.to_number("raw").alias("value")).where(
        F.col("value").isNotNull())


def sparse_records(obs: DataFrame) -> DataFrame:
    """Observations per location of a sparse table with its newest value."""
    known = obs.withColumn("value", coerce.to_number("raw")).where(F.col("value").isNotNull())
    return known.groupBy("source", "sheet", F.col("metric").alias("location")).agg(
        F.count("value").alias("observations"), F.avg("value").alias("mean"), F.max("ts").alias("latest_ts"), F.max_by("value", "ts").alias("latest"))


def best_covered(records: DataFrame, least: int = 2) -> DataFrame:
    """The location with most observations in each sheet, if it has at least ``least``."""
    best = F.max_by(F.struct("location", "observations", "latest"), F.struct("observations", "location"))
    return records.where(F.col("observations") >= least).groupBy("source", "sheet").agg(best.alias("_b")).select("source", "sheet", "_b.*")


def _keyword_hits(words):
    """Sheet names still free that contain every word, and how much of each name the words cover."""
    size = float(sum(len(w) for w in words))

    def fits(name):
        hit = F.lit(True)
        for word in words:
            hit = hit & coerce.squashed(name).contains(word)
        return hit
    hits = F.filter("_left", fits)
    return hits, F.transform(hits, lambda n: size / F.greatest(F.length(coerce.squashed(n)), F.lit(1)))


def assign_sheets(sheets: DataFrame, specs) -> DataFrame:
    """Give each sheet of a source to at most one spec, the spec with most keywords choosing first.

    ``specs`` is an ordered list of (key, keywords).  A workbook's sheet names are one short array, from which the
    specs take the best covered match in turn.
    """
    def plain(word):
        return "".join(ch for ch in word.lower() if ch.isalnum())

    rows = sheets.groupBy("source").agg(F.array_sort(F.collect_set("sheet")).alias("_left"))
    taken = []
    for key, words in sorted(specs, key=lambda s: -len(s[1])):
        hits, cover = _keyword_hits([plain(w) for w in words])
        rows = rows.withColumn("_hits", hits).withColumn("_cover", cover)
        spot = F.array_position("_cover", F.array_max("_cover")).cast("int")
        rows = rows.withColumn(f"_s{len(taken)}", F.when(F.size("_hits") > 0, F.element_at("_hits", spot)))
        rows = rows.withColumn("_left", F.coalesce(F.array_remove("_left", F.col(f"_s{len(taken)}")), F.col("_left")))
        taken.append(key)
    choices = [F.struct(F.lit(k).alias("key"), F.col(f"_s{i}").alias("sheet")) for i, k in enumerate(taken)]
    spare = F.transform("_left", lambda n: F.struct(F.lit("(unmapped)").alias("key"), n.alias("sheet")))
    return rows.select("source", F.explode(F.concat(F.array(*choices), spare)).alias("_x")).select("source", "_x.*")


def line_item(items: DataFrame, keyword: str) -> DataFrame:
    """First line (in sheet order) whose label contains the keyword, punctuation ignored."""
    need = "".join(ch for ch in keyword.lower() if ch.isalnum())
    hit = items.where(coerce.squashed("item").contains(need))
    first = hit.groupBy(*SHEET).agg(F.min("r").alias("r"))
    return hit.join(first, SHEET + ["r"])
