from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import coerce
from tidemark.operators import quality as Q, reshape as R


@pytest.fixture(scope="module")
def book(spark):
    """Five small sheets full of the usual quirks, as landed cells."""
    sheets = {
        "LongSheet": [["Date", "Price", "Arrivals"], ["2024-01-01", "100", "10"], ["2024-01-02", "Closed", "20"], ["2024-01-03", "-20", "30"], ["2024-01-04", "110", "TBD"],
                      ["2024-01-01", "100", "10"], ["2024-01-05", None, None], [None, None, None]],
        "MergedSheet": [["Date", "VarietyA", None, "VarietyB", None], [None, "Low", "High", "Low", "High"], ["2024-01-01", "1", "2", "3", "4"], ["2024-01-02", "5", "#DIV/0!", "7", "8"]],
        "PivotSheet": [["Year", "Jan", "Feb"], ["2024", "1", "2"], ["2025", "3", None], ["note: source", "9", "9"]],
        "StackedTablesSheet": [["Months", "2024", "2025"], ["Jan", "1", "2"], ["Feb", "3", "4"], [None, None, None], ["Months", "2024", "2025"], ["Jan", "10", "20"], ["Feb", "30", "40"]],
        "UnconfiguredSheet": [["A", "B"], ["1", "2"]],
    }
    rows = [("book", name, r + 1, c + 1, v) for name, grid in sheets.items() for r, line in enumerate(grid) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "source string, sheet string, r int, c int, v string").repartition(5)


LONG = R.SheetSpec("LongSheet", "long", columns={"Price": ("price", "price"), "arrivals": ("arrivals", "arrival")})
MERGED = R.SheetSpec("MergedSheet", "wide_pivot_merged_header", metric_row=2, data_start=3, columns={"Low": ("low_price", "price"), "High": ("high_price", "price")},
                     overrides={5: ("special", "index", "Extra")}, estimate_labels=("VarietyA",))
PIVOT = R.SheetSpec("PivotSheet", "wide_pivot_year_month", id_role="year", filters=("id_is_4digit_year",))
STACKED = R.SheetSpec("StackedTablesSheet", "wide_pivot_year_month", id_role="month_name", filters=("stop_at_blank_id",))
SPECS = [LONG, MERGED, PIVOT, STACKED, R.SheetSpec("Gone", "long"), R.SheetSpec("Derived", "derived_skip")]
TOKENS = ("closed", "", "#DIV/0!")


def test_long_sheet_trims_rows_without_id(book, rows):
    out = rows(R.parse_long(book.where("sheet = 'LongSheet'"), LONG), "row_ref", "metric")
    assert len(out) == 12 and out[0]["metric"] == "arrivals" and out[2]["raw"] == "20" and out[3]["raw"] == "Closed"


def test_merged_header_fill_override_and_estimates(book, rows):
    out = {(str(r["ts"]), r["group_key"], r["metric"]): r for r in rows(R.parse_merged_header(book.where("sheet = 'MergedSheet'"), MERGED))}
    assert len(out) == 8 and out["2024-01-01", "VarietyA", "high_price"]["raw"] == "2"
    assert out["2024-01-02", "Extra", "special"]["raw"] == "8" and out["2024-01-02", "VarietyB", "low_price"]["role"] == "price"
    assert out["2024-01-01", "VarietyA", "low_price"]["is_estimate"] and not out["2024-01-01", "VarietyB", "low_price"]["is_estimate"]


def test_pivot_sheet_leaves_the_legend_out_but_keeps_null_cells(book, rows):
    out = rows(R.parse_year_month(book.where("sheet = 'PivotSheet'"), PIVOT), "ts")
    assert [(str(r["ts"]), r["raw"]) for r in out] == [("2024-01-01", "1"), ("2024-02-01", "2"), ("2025-01-01", "3"), ("2025-02-01", None)]


def test_stacked_sheet_stops_at_the_blank_or_splits(book, rows):
    cells = book.where("sheet = 'StackedTablesSheet'")
    assert [r["raw"] for r in rows(R.parse_year_month(cells, STACKED), "ts")] == ["1", "3", "2", "4"]
    blocks = R.stacked_blocks(cells)
    assert blocks.where("block = 2").count() == 4
    r = rows(R.block_ratio(blocks))[0]
    assert (r["ratio"], r["constant"], r["n"]) == (10.0, True, 4)


def test_status_of_every_sheet(book, rows):
    out = {r["sheet"]: (r["status"], r["reason"]) for r in rows(R.sheet_status(book, SPECS))}
    assert out["LongSheet"][0] == "parsed" and out["UnconfiguredSheet"] == ("unconfigured", "no configuration")
    assert out["Gone"] == ("skipped", "configured but not found")
    assert R.parse(book, SPECS).select("sheet").distinct().count() == 4


def test_cleaning_logs_what_it_changes(book, rows):
    obs = R.parse_long(book.where("sheet = 'LongSheet'"), LONG)
    clean = Q.cleaned(obs, TOKENS)
    by = {(r["row_ref"], r["metric"]): r for r in rows(clean)}
    assert by[3, "price"]["value"] is None and by[3, "price"]["action"] == "token_to_null"
    assert by[4, "price"]["value"] == -20.0 and by[5, "price"]["action"] == "numeric_string_converted"
    assert by[5, "arrivals"]["text"] == "TBD" and by[5, "arrivals"]["action"] is None
    log = rows(Q.cleaning_log(clean), "row_ref")
    assert {r["original_value"] for r in log} >= {"Closed", "110"}
    assert 7 not in {r["row_ref"] for r in rows(Q.without_blank_rows(clean))}


def test_validation_counts(book, rows):
    obs = R.parse_long(book.where("sheet = 'LongSheet'"), LONG)
    out = {r["metric"]: r for r in rows(Q.validation_report(obs, TOKENS))}
    assert (out["price"]["missing"], out["price"]["negative_values"], out["arrivals"]["text_contamination"]) == (2, 1, 1)
    assert out["price"]["duplicate_rows"] == 4
    assert {(r["issue"], r["raw"]) for r in rows(Q.offenders(obs, TOKENS))} == {("text_contamination", "TBD"), ("negative_value", "-20")}
    merged = R.parse_merged_header(book.where("sheet = 'MergedSheet'"), MERGED)
    assert sum(r["estimate_rows"] for r in rows(Q.validation_report(merged, TOKENS))) == 4


def test_hot_sheet_is_parsed_whole(spark):
    """One sheet far larger than the others loses nothing."""
    n = 3000
    big = spark.range(n).select(F.lit("s").alias("source"), F.lit("Big").alias("sheet"), (F.col("id") + 2).cast("int").alias("r"), F.explode(F.array(F.lit(1), F.lit(2))).alias("c")).withColumn(
        "v", F.when(F.col("c") == 1, F.date_format(F.date_add(F.lit(date(2000, 1, 1)), F.col("r")), "yyyy-MM-dd")).otherwise(F.col("r").cast("string")))
    head = spark.createDataFrame([("s", "Big", 1, 1, "Date"), ("s", "Big", 1, 2, "Price")], big.schema)
    out = R.parse_long(big.unionByName(head), R.SheetSpec("Big", "long", columns={"Price": ("price", "price")}))
    assert out.count() == n and out.select(F.sum(coerce.to_number("raw"))).first()[0] == sum(range(2, n + 2))


def test_square_matrix_particulars_and_line_item(spark, rows):
    grid = [["", "A", "B"], ["A", "1", "0.5"], ["B", "0.5", "1"]]
    cells = spark.createDataFrame([("s", "M", r + 1, c + 1, v) for r, line in enumerate(grid) for c, v in enumerate(line)], "source string, sheet string, r int, c int, v string")
    assert len(rows(R.square_matrix(cells))) == 4
    grid = [["Title", None, None, None], ["Particulars", "2023", "2024", "2025(exp)"], ["Stock-to-Use %", "1", "2", "3"], ["Production", "4", "5", "6"]]
    cells = spark.createDataFrame([("s", "B", r + 1, c + 1, v) for r, line in enumerate(grid) for c, v in enumerate(line)], cells.schema)
    items = R.particulars_by_year(cells)
    assert [(r["year"], r["value"], r["is_estimate"]) for r in rows(R.line_item(items, "stock to use"), "year")] == [(2023, 1.0, False), (2024, 2.0, False), (2025, 3.0, True)]


def test_sheets_are_claimed_once(spark, rows):
    sheets = spark.createDataFrame([("w", "North Alpha cold storage"), ("w", "North Alpha non cold storage"), ("w", "Other")], "source string, sheet string")
    out = {r["key"]: r["sheet"] for r in rows(R.assign_sheets(sheets, [("cold", ("north", "cold")), ("non_cold", ("north", "non", "cold"))]))}
    assert out == {"cold": "North Alpha cold storage", "non_cold": "North Alpha non cold storage", "(unmapped)": "Other"}


def test_column_profile_and_coverage(spark, series, rows):
    t = spark.createDataFrame([(1, "a", None), (2, None, None)], "k int, high_price string, z double")
    out = {r["column"]: r for r in rows(Q.column_profile(t, "t"))}
    assert out["high_price"]["non_null"] == 1 and out["high_price"]["role"] == "high" and out["z"]["non_null"] == 0
    cov = {r["series_id"]: r["status"] for r in rows(Q.coverage_table(series({"a": [1]}), ["a", "b"]))}
    assert cov == {"a": "OK", "b": "data not available"}
