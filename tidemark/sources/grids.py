"""The star-schema tables laid out as landed sheets, to feed the grid parsers."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.operators.series import resample
from tidemark.sources import tables as T
from tidemark.sources.store import landed


def _cells(rows: DataFrame, source, sheet: str, r: Column, c: Column, v: Column) -> DataFrame:
    return rows.select(F.col(source).alias("source") if isinstance(source, str) else source.alias("source"), F.lit(sheet).alias("sheet"),
                       r.cast("bigint").alias("r"), c.cast("int").alias("c"), v.cast("string").alias("v"))


def _spread(rows: DataFrame, source, sheet: str, r: Column, values: list, first: Column | int = 1) -> DataFrame:
    """Neighbouring cells of each row, from column ``first``, in one pass."""
    base = F.lit(first) if isinstance(first, int) else first
    cells = F.array(*[F.struct((base + i).cast("int").alias("c"), v.cast("string").alias("v")) for i, v in enumerate(values)])
    own = F.col(source) if isinstance(source, str) else source
    return rows.select(own.alias("source"), F.lit(sheet).alias("sheet"), r.cast("bigint").alias("r"), F.inline(cells))


def _header(sources: DataFrame, sheet: str, r: int, labels: dict) -> DataFrame:
    """Fixed header labels repeated for every source; keys are columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(t).alias("t")) for c, t in labels.items()]))
    return _cells(sources.select("source", pairs.alias("_h")), "source", sheet, F.lit(r), F.col("_h.c"), F.col("_h.t"))


def union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def year_month_sheet(spark, sf_dir) -> DataFrame:
    """One workbook per variety: years down, months across, a total row and a legend below."""
    m = landed(resample(T.prices(spark, sf_dir), "MS").select(F.col("series_id").alias("source"), F.year("ts").alias("y"), F.month("ts").alias("m"), "value"))
    sources = m.select("source").distinct()
    body = _cells(m, "source", "Monthly price", F.col("y") - 1990, F.col("m") + 1, F.col("value"))
    ids = _cells(m.select("source", "y").distinct(), "source", "Monthly price", F.col("y") - 1990, F.lit(1), F.col("y"))
    totals = _cells(m.groupBy("source", "m").agg(F.sum("value").alias("t")), "source", "Monthly price", F.lit(500), F.col("m") + 1, F.col("t"))
    legend = _header(sources, "Monthly price", 500, {1: "Total"}).unionByName(_header(sources, "Monthly price", 502, {1: "note: prices", 2: "100"}))
    return union([_header(sources, "Monthly price", 1, {1: "Year", **{i + 2: t.title() for i, t in enumerate(fixed.MONTHS)}}), body, ids, totals, legend])


def daily_sheet(spark, sf_dir) -> DataFrame:
    """Date, price-like and volume columns under one header, one workbook for each line status."""
    li = T.read(spark, sf_dir, "lineitem")
    d = landed(li.groupBy(F.col("l_linestatus").alias("source"), F.to_date("l_shipdate").alias("ts")).agg(
        F.sum("l_quantity").alias("q"), F.max("l_extendedprice").alias("p")))
    r = F.datediff("ts", F.lit("1990-01-01").cast("date"))
    sources = d.select("source").distinct()
    return union([_header(sources, "Daily", 1, {1: "Date", 2: "Arrivals (bags)", 3: "Price", 4: "Remark"}),
                  _spread(d, "source", "Daily", r, [F.date_format("ts", "dd-MMM-yyyy"), F.when(F.dayofweek("ts") == 1, "Closed").otherwise(F.col("q").cast("string")),
                                                    F.concat(F.lit(" "), F.format_string("%.2f", "p")), F.lit("x")])])


def quote_sheet(spark, sf_dir) -> DataFrame:
    """Low, high and average per variety under a merged variety header."""
    q = landed(T.quotes(spark, sf_dir).select("series_id", "ts", "low", "high", "avg"))
    r = F.datediff("ts", F.lit("1990-01-01").cast("date"))
    spot = F.create_map(*[F.lit(x) for i, v in enumerate(T.VARIETIES) for x in (v, 2 + 3 * i)])
    base = F.try_element_at(spot, F.col("series_id"))
    quoted = _spread(q, F.lit("quotes"), "Varieties", r, [F.col(c) for c in ("low", "high", "avg")], base)
    one = q.select(F.lit("quotes").alias("source")).distinct()
    group = {c: (T.VARIETIES[(c - 2) // 3] if (c - 2) % 3 == 0 else None) for c in range(2, 2 + 3 * len(T.VARIETIES))}
    metric = {c: ("Low", "High", "Avg")[(c - 2) % 3] for c in group}
    ids = _cells(q.select("ts").distinct(), F.lit("quotes"), "Varieties", r, F.lit(1), F.col("ts"))
    return union([_header(one, "Varieties", 1, {1: "Date", **group}), _header(one, "Varieties", 2, metric), ids, quoted])


def balance_sheet(spark, sf_dir) -> DataFrame:
    """Lines by year with an expected last year, a title row above the header."""
    b = T.balance(spark, sf_dir)
    r = F.dense_rank().over(Window.partitionBy("year_label").orderBy("category")) + 3
    rows = landed(b.withColumn("_r", r).withColumn("source", F.lit("balance")))
    one = rows.select("source").distinct()
    return union([_header(one, "Balance", 1, {1: "Supply and demand"}), _header(one, "Balance", 3, {1: "Particulars"}),
                  _cells(rows.select("source", "year", "year_label").distinct(), "source", "Balance", F.lit(3), F.col("year") - 1993, F.col("year_label")),
                  _cells(rows.select("source", "_r", "category").distinct(), "source", "Balance", F.col("_r"), F.lit(1), F.col("category")),
                  _cells(rows, "source", "Balance", F.col("_r"), F.col("year") - 1993, F.col("value"))])


def tracker_sheet(spark, sf_dir) -> DataFrame:
    """Year and month columns next to one stock column per line status."""
    li = T.read(spark, sf_dir, "lineitem")
    m = li.groupBy(F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m")).agg(
        F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("f"), F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))).alias("o"))
    r = (F.col("y") - 1990) * 12 + F.col("m")
    m = landed(m.withColumn("source", F.lit("tracker")))
    names = F.element_at(F.array(*[F.lit(x.title()) for x in fixed.MONTHS]), F.col("m"))
    return union([_header(m.select("source").distinct(), "Stock", 1, {1: "Year", 2: "Month", 3: "North stock", 4: "South stock"}),
                  _spread(m, "source", "Stock", r, [F.col("y"), names, F.col("f"), F.col("o")])])


def stacked_sheet(spark, sf_dir) -> DataFrame:
    """Months down, years across, twice: the second block is the first in another unit."""
    e = landed(T.exports(spark, sf_dir).select(F.year("ts").alias("y"), F.month("ts").alias("m"), "value").withColumn("source", F.lit("exports")))
    names = F.element_at(F.array(*[F.lit(x.title()) for x in fixed.MONTHS]), F.col("m"))
    parts = []
    for top, factor in ((1, 1.0), (20, 0.045)):
        parts += [_header(e.select("source").distinct(), "Exports", top, {1: "Months"}),
                  _cells(e.select("source", "y").distinct(), "source", "Exports", F.lit(top), F.col("y") - 1990, F.col("y")),
                  _cells(e.select("source", "m").distinct(), "source", "Exports", F.col("m") + top, F.lit(1), names),
                  _cells(e, "source", "Exports", F.col("m") + top, F.col("y") - 1990, F.col("value") * factor)]
    return union(parts)


def state_sheet(spark, sf_dir) -> DataFrame:
    """Nations down; per order year the number, value and mean of the customers' orders across."""
    o = T.read(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(
        F.count("o_totalprice").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s"))
    c = T.read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = T.read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    t = (o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "y").agg(F.sum("n").alias("n"), F.sum("s").cast("double").alias("s"))
         .join(n, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("source", F.lit("states")))
    base = (F.col("y") - 1995) * 3 + 2
    r = F.col("n_nationkey") + 3
    years = t.select("source", "y").distinct()
    heads = [_cells(years, "source", "States", F.lit(1), base, F.col("y"))]
    heads += [_cells(years, "source", "States", F.lit(1), base + i, F.lit(None)) for i in (1, 2)]
    heads += [_cells(years, "source", "States", F.lit(2), base + i, F.lit(x)) for i, x in enumerate(("Area", "Production", "Yield"))]
    return union(heads + [_cells(t.select("source", "n_nationkey", "n_name").distinct(), "source", "States", r, F.lit(1), F.col("n_name")),
                          _cells(t, "source", "States", r, base, F.col("n")), _cells(t, "source", "States", r, base + 1, F.col("s")),
                          _cells(t, "source", "States", r, base + 2, F.col("s") / F.col("n"))])


def matrix_sheet(pairs: DataFrame, names) -> DataFrame:
    """A labelled square matrix from (a, b, value) rows."""
    spot = F.create_map(*[F.lit(x) for i, v in enumerate(names) for x in (v, 2 + i)])
    one = pairs.select(F.lit("matrix").alias("source")).distinct()
    return union([_header(one, "Matrix", 1, {i + 2: n for i, n in enumerate(names)}),
                  _cells(pairs.select("a").distinct(), F.lit("matrix"), "Matrix", F.try_element_at(spot, F.col("a")), F.lit(1), F.col("a")),
                  _cells(pairs, F.lit("matrix"), "Matrix", F.try_element_at(spot, F.col("a")), F.try_element_at(spot, F.col("b")), F.col("value"))])


def dirty_cells(spark, sf_dir) -> DataFrame:
    """Event values as hand-typed text: separators, padding, missing tokens and stray words, depending on the event."""
    e = T.read(spark, sf_dir, "events")
    plain = F.format_string("%.2f", "value")
    k = F.pmod("event_id", F.lit(11))
    raw = (F.when(k == 0, "Closed").when(k == 1, "#DIV/0!").when(k == 2, F.concat(F.lit("  "), plain, F.lit(" "))).when(k == 3, F.concat(F.lit("1,"), plain))
           .when(k == 4, "TBD").when(k == 5, F.concat(F.lit("-"), plain)).when(k == 6, "").when(k == 7, " see note ").when(k == 8, F.lit(None)).otherwise(plain))
    day = F.when(F.pmod("event_id", F.lit(97)) == 0, "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return e.select(F.concat(F.lit("book"), F.col("user_id").cast("string")).alias("source"), F.col("event_type").alias("sheet"),
                    F.col("event_id").cast("bigint").alias("row_ref"), day.alias("id"), F.to_date("ts").alias("ts"), F.lit(None).cast("string").alias("group_key"),
                    F.col("event_type").alias("metric"), F.when(F.col("event_type") == "error", "note").otherwise("price").alias("role"),
                    F.lit(None).cast("string").alias("year_label"), (F.col("event_type") == "signup").alias("is_estimate"), raw.alias("raw"))
