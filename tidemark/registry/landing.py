"""Landed grids: parsing, cleaning, validation, coverage."""

from pyspark.sql import functions as F

from tidemark.functions import coerce
from tidemark.operators import quality as Q, reshape as R, stats
from tidemark.registry.base import BALANCE, EXPORTS, MARKET, PAIRS, PRICE, VOLUME, longs, query, r, rounded
from tidemark.registry.pairs import market_pairs
from tidemark.sources import grids as G, tables as T
from tidemark.sources.store import landed

YEAR_MONTH = R.SheetSpec("Monthly price", "wide_pivot_year_month", id_role="year", value_role="price", filters=("id_is_4digit_year", "exclude_total_row"))
DAILY = R.SheetSpec("Daily", "long", data_start=2, columns={"Arrivals (bags)": ("arrivals", "arrival"), "Price": ("price", "price")})
QUOTES = R.SheetSpec("Varieties", "wide_pivot_merged_header", header_row=1, metric_row=2, data_start=3,
                     columns={"low": ("low_price", "price"), "high": ("high_price", "price"), "avg": ("avg_price", "price")})
BALANCES = R.SheetSpec("Balance", "wide_pivot_year_cols", header_row=3, data_start=4, id_role="category", value_role="production", estimate_labels=("2001(exp)",))
STOCK = R.SheetSpec("Stock", "sparse_tracker", columns={"North stock": ("north", "storage_stock"), "South stock": ("south", "storage_stock")})
STACKED_FIRST = R.SheetSpec("Exports", "wide_pivot_year_month", id_role="month_name", filters=("stop_at_blank_id",))


@query("unpivot_year_month", f"WITH {PRICE} SELECT series_id AS source, year(ts) AS year, CAST(date_trunc('month', ts) AS DATE) AS ts, {r('avg(value)')} AS value FROM price GROUP BY 1, 2, 3")
def unpivot_year_month(spark, sf):
    obs = R.parse_year_month(landed(G.year_month_sheet(spark, sf)), YEAR_MONTH).where("raw is not null")
    return rounded(longs(obs.select("source", F.col("year_label").cast("int").alias("year"), "ts", coerce.to_number("raw").alias("value"))))


@query("unpivot_month_year_first_block", "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS ts, sum(l_quantity) AS value FROM lineitem WHERE l_returnflag='R' GROUP BY 1")
def unpivot_month_year_first_block(spark, sf):
    return R.parse_year_month(landed(G.stacked_sheet(spark, sf)), STACKED_FIRST).select("ts", coerce.to_number("raw").alias("value"))


@query("parse_long", """WITH d AS (SELECT l_linestatus AS source, CAST(l_shipdate AS DATE) AS ts, sum(l_quantity) AS q, max(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2)
 SELECT source, ts, 'arrivals' AS metric, 'arrival' AS role, CASE WHEN isodow(ts) <> 7 THEN q END AS value FROM d UNION ALL SELECT source, ts, 'price', 'price', p FROM d""")
def parse_long(spark, sf):
    return R.parse_long(landed(G.daily_sheet(spark, sf)), DAILY).select("source", "ts", "metric", "role", coerce.to_number("raw").alias("value"))


@query("merged_header", f"""WITH q AS (SELECT o_orderpriority AS group_key, CAST(o_orderdate AS DATE) AS ts, min(o_totalprice) AS low_price, max(o_totalprice) AS high_price,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)/count(*) AS avg_price FROM orders GROUP BY 1, 2)
 SELECT group_key, ts, {r('low_price')} AS low_price, {r('high_price')} AS high_price, {r('avg_price')} AS avg_price FROM q""")
def merged_header(spark, sf):
    obs = R.parse_merged_header(landed(G.quote_sheet(spark, sf)), QUOTES).withColumn("value", coerce.to_number("raw"))
    wide = R.widen(obs, ["low_price", "high_price", "avg_price"])
    return rounded(wide.select("group_key", "ts", "low_price", "high_price", "avg_price"))


@query("header_ffill", "SELECT i*3+k+2 AS c, p AS group_key FROM (SELECT p, row_number() OVER (ORDER BY p) - 1 AS i FROM (SELECT DISTINCT o_orderpriority AS p FROM orders)), (SELECT unnest([0,1,2]) AS k)")
def header_ffill(spark, sf):
    return longs(R.filled_header(landed(G.quote_sheet(spark, sf)), 1).where("c > 1").select("c", "group_key"))


@query("year_columns", f"WITH {BALANCE} SELECT category AS id, year_label, is_estimate, {r('value')} AS value FROM balance")
def year_columns(spark, sf):
    obs = R.parse_year_columns(landed(G.balance_sheet(spark, sf)), BALANCES)
    return rounded(obs.select("id", "year_label", "is_estimate", coerce.to_number("raw").alias("value")))


@query("parse_tracker", """WITH m AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS ts, sum(CASE WHEN l_linestatus='F' THEN l_quantity END) AS f, sum(CASE WHEN l_linestatus='O' THEN l_quantity END) AS o FROM lineitem GROUP BY 1)
 SELECT ts, 'north' AS metric, f AS value FROM m UNION ALL SELECT ts, 'south', o FROM m""")
def parse_tracker(spark, sf):
    return R.parse_tracker(landed(G.tracker_sheet(spark, sf)), STOCK).select("ts", "metric", coerce.to_number("raw").alias("value"))


def _book(spark, sf):
    return landed(G.union([G.year_month_sheet(spark, sf), G.daily_sheet(spark, sf), G.quote_sheet(spark, sf), G.balance_sheet(spark, sf),
                           G.tracker_sheet(spark, sf), G.stacked_sheet(spark, sf)]))


SPECS = [YEAR_MONTH, DAILY, QUOTES, BALANCES, STOCK, R.SheetSpec("Correlations", "derived_skip"), R.SheetSpec("Missing sheet", "long")]


@query("parse_workbook", f"""WITH {PRICE}, {BALANCE}, d AS (SELECT CAST(l_shipdate AS DATE) AS ts, l_linestatus AS source, sum(l_quantity) AS q, max(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2),
 o AS (SELECT o_orderpriority AS g, CAST(o_orderdate AS DATE) AS ts, min(o_totalprice) AS low_price, max(o_totalprice) AS high_price, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)/count(*) AS avg_price FROM orders GROUP BY 1, 2),
 u AS (SELECT 'Monthly price' AS sheet, series_id AS source, CAST(date_trunc('month', ts) AS DATE) AS ts, NULL AS group_key, 'value' AS metric, 'price' AS role, CAST(year(ts) AS VARCHAR) AS year_label, false AS is_estimate, avg(value) AS value FROM price GROUP BY ALL
  UNION ALL SELECT 'Daily', source, ts, NULL, 'arrivals', 'arrival', NULL, false, CASE WHEN isodow(ts) <> 7 THEN q END FROM d UNION ALL SELECT 'Daily', source, ts, NULL, 'price', 'price', NULL, false, p FROM d
  UNION ALL SELECT 'Varieties', 'quotes', ts, g, m, 'price', NULL, false, v FROM (UNPIVOT o ON low_price, high_price, avg_price INTO NAME m VALUE v)
  UNION ALL SELECT 'Balance', 'balance', NULL, category, 'value', 'production', year_label, is_estimate AND year_label = '2001(exp)', value FROM balance
  UNION ALL SELECT 'Stock', 'tracker', CAST(date_trunc('month', ts) AS DATE), NULL, CASE source WHEN 'F' THEN 'north' ELSE 'south' END, 'storage_stock', CAST(year(ts) AS VARCHAR), false, sum(q) FROM d GROUP BY ALL)
 SELECT sheet, source, ts, group_key, metric, role, year_label, is_estimate, {r('value')} AS value FROM u WHERE value IS NOT NULL""")
def parse_workbook(spark, sf):
    obs = R.parse(_book(spark, sf), SPECS).withColumn("value", coerce.to_number("raw")).where("value is not null")
    return rounded(obs.select("sheet", "source", "ts", "group_key", "metric", "role", "year_label", "is_estimate", "value"))


@query("parse_tags", f"""WITH {PRICE}, m AS (SELECT series_id, month(ts) AS mo, CAST(date_trunc('month', ts) AS DATE) AS ts, avg(value) AS v FROM price GROUP BY ALL), s AS (SELECT DISTINCT series_id FROM price)
 SELECT series_id AS source, 'observation' AS tag, count(*) AS cells, {r('sum(v)', 2)} AS total FROM m GROUP BY 1 UNION ALL SELECT series_id, 'total', count(DISTINCT mo), {r('sum(v)', 2)} FROM m GROUP BY 1 UNION ALL SELECT series_id, 'legend', 1, 100.0::DOUBLE FROM s""")
def parse_tags(spark, sf):
    """Observations, supplied totals and legend of the monthly sheets."""
    tagged = R.parse_tagged(landed(G.year_month_sheet(spark, sf)), [YEAR_MONTH]).withColumn("value", coerce.to_number("raw")).where("value is not null")
    return rounded(tagged.groupBy("source", "tag").agg(F.count(F.lit(1)).alias("cells"), F.sum("value").alias("total")), 2)


@query("sheet_status", """SELECT * FROM (VALUES ('Monthly price','wide_pivot_year_month',(SELECT count(DISTINCT o_orderpriority) FROM orders),'parsed',NULL), ('Daily','long',(SELECT count(DISTINCT l_linestatus) FROM lineitem),'parsed',NULL),
 ('Varieties','wide_pivot_merged_header',1,'parsed',NULL), ('Balance','wide_pivot_year_cols',1,'parsed',NULL), ('Stock','sparse_tracker',1,'parsed',NULL), ('Exports',NULL,1,'unconfigured','no configuration'),
 ('Correlations','derived_skip',0,'skipped','configured but not found'), ('Missing sheet','long',0,'skipped','configured but not found')) AS t(sheet, layout, sources, status, reason)""")
def sheet_status(spark, sf):
    return R.sheet_status(_book(spark, sf), SPECS)


@query("stacked_blocks", f"WITH {EXPORTS} SELECT 1 AS block, ts, {r('value')} AS value FROM exports UNION ALL SELECT 2, ts, {r('value*0.045')} FROM exports")
def stacked_blocks(spark, sf):
    return rounded(longs(R.stacked_blocks(landed(G.stacked_sheet(spark, sf))).select("block", "ts", "value")))


@query("block_ratio", f"WITH {EXPORTS} SELECT 'exports' AS source, 'Exports' AS sheet, 0.045::DOUBLE AS ratio, true AS constant, count(*) AS n FROM exports")
def block_ratio(spark, sf):
    return rounded(R.block_ratio(R.stacked_blocks(landed(G.stacked_sheet(spark, sf)))), 6)


@query("particulars_by_year", f"WITH {BALANCE} SELECT category AS item, year, is_estimate, {r('value')} AS value FROM balance")
def particulars_by_year(spark, sf):
    return rounded(longs(R.particulars_by_year(landed(G.balance_sheet(spark, sf))).select("item", "year", "is_estimate", "value")))


@query("line_item", f"WITH {BALANCE} SELECT year, {r('value')} AS value FROM balance WHERE category = 'Total Demand'")
def line_item(spark, sf):
    return rounded(longs(R.line_item(R.particulars_by_year(landed(G.balance_sheet(spark, sf))), "total-demand").select("year", "value")))


_STATES = """SELECT n_name AS state, year(o_orderdate) AS year, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS s
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"""


@query("state_year_metrics", f"SELECT state, year, {r('n')} AS area, {r('s')} AS production, {r('s/n')} AS yield FROM ({_STATES})")
def state_year_metrics(spark, sf):
    return rounded(longs(R.state_year_metrics(landed(G.state_sheet(spark, sf))).select("state", "year", "area", "production", "yield")))


@query("national_row", f"SELECT state, year, {r('n')} AS area, {r('s')} AS production FROM ({_STATES}) WHERE state LIKE '%INDIA%' OR NOT EXISTS (SELECT 1 FROM nation WHERE n_name LIKE '%INDIA%')")
def national_row(spark, sf):
    return rounded(longs(R.national_row(R.state_year_metrics(landed(G.state_sheet(spark, sf)))).select("state", "year", "area", "production")))


_MATRIX = f"WITH {MARKET}, {PAIRS}, c AS (SELECT a, b, covar_pop(x,y)/(stddev_pop(x)*stddev_pop(y)) AS r FROM pr GROUP BY 1, 2)"


@query("square_matrix", f"{_MATRIX} SELECT a AS row_label, b AS col_label, {r('r', 6)} AS value FROM c")
def square_matrix(spark, sf):
    p = stats.pearson(market_pairs(spark, sf)).select("a", "b", F.col("r").alias("value"))
    return rounded(R.square_matrix(G.matrix_sheet(p, T.MARKETS)).select("row_label", "col_label", "value"), 6)


@query("reconcile_matrix", f"{_MATRIX} SELECT {r('0.0', 6)} AS median_abs_difference, {r('0.0', 6)} AS max_abs_difference, count(*) AS n FROM c")
def reconcile_matrix(spark, sf):
    p = stats.pearson(market_pairs(spark, sf)).select("a", "b", F.col("r").alias("value"))
    supplied = R.square_matrix(G.matrix_sheet(p, T.MARKETS)).select(
        F.col("row_label").alias("a"), F.col("col_label").alias("b"), "value")
    return rounded(Q.reconcile_summary(Q.reconcile(p, supplied, ["a", "b"], "value")), 6)


_TRACK = "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS ts, CASE WHEN l_linestatus='F' THEN 'north' ELSE 'south' END AS location, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2"


@query("sparse_records", f"SELECT location, count(*) AS observations, {r('avg(v)')} AS mean, max(ts) AS latest_ts, {r('arg_max(v, ts)')} AS latest FROM ({_TRACK}) GROUP BY 1")
def sparse_records(spark, sf):
    return rounded(R.sparse_records(R.parse_tracker(landed(G.tracker_sheet(spark, sf)), STOCK)).drop("source", "sheet"))


@query("best_covered", f"SELECT location, count(*) AS observations, arg_max(v, ts) AS latest FROM ({_TRACK}) GROUP BY 1 ORDER BY observations DESC, location DESC LIMIT 1")
def best_covered(spark, sf):
    return R.best_covered(R.sparse_records(R.parse_tracker(landed(G.tracker_sheet(spark, sf)), STOCK))).drop("source", "sheet")


@query("trim_grid", """SELECT count(*) AS cells FROM (SELECT o_orderpriority, date_trunc('month', o_orderdate) FROM orders GROUP BY 1, 2)""")
def trim_grid(spark, sf):
    grid = landed(G.year_month_sheet(spark, sf)).where("r > 1 and r < 500 and c > 1")
    padded = grid.unionByName(grid.withColumn("r", F.col("r") + 1000).withColumn("v", F.lit(" "))).unionByName(
        grid.withColumn("c", F.col("c") + 100).withColumn("v", F.lit(None).cast("string")))
    return R.trimmed(padded).agg(F.count(F.lit(1)).alias("cells"))


@query("assign_sheets", """WITH s AS (SELECT r_name AS source, n_name AS sheet FROM nation JOIN region ON n_regionkey = r_regionkey),
 a AS (SELECT source, min(sheet) FILTER (sheet LIKE '%UNITED%' AND sheet LIKE '%K%') AS s1 FROM s GROUP BY 1),
 b AS (SELECT a.source, s1, (SELECT sheet FROM s WHERE s.source = a.source AND sheet LIKE '%UNITED%' AND (s1 IS NULL OR sheet <> s1) ORDER BY length(replace(sheet,' ','')), sheet LIMIT 1) AS s2 FROM a),
 c AS (SELECT b.*, (SELECT sheet FROM s WHERE s.source = b.source AND sheet LIKE '%IA%' AND sheet IS DISTINCT FROM s1 AND sheet IS DISTINCT FROM s2 ORDER BY length(replace(sheet,' ','')), sheet LIMIT 1) AS s3 FROM b)
 SELECT source, 'united_k' AS key, s1 AS sheet FROM c UNION ALL SELECT source, 'united', s2 FROM c UNION ALL SELECT source, 'ia', s3 FROM c
 UNION ALL SELECT s.source, '(unmapped)', sheet FROM s JOIN c ON s.source = c.source WHERE sheet IS DISTINCT FROM s1 AND sheet IS DISTINCT FROM s2 AND sheet IS DISTINCT FROM s3""")
def assign_sheets(spark, sf):
    n, g = T.read(spark, sf, "nation"), T.read(spark, sf, "region")
    sheets = n.join(g, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("source"), F.col("n_name").alias("sheet"))
    return R.assign_sheets(sheets, [("united", ["united"]), ("united_k", ["united", "k"]), ("ia", ["ia"])])


@query("numbered_roles", """WITH q AS (SELECT row_number() OVER (ORDER BY p) - 1 AS i FROM (SELECT DISTINCT o_orderpriority AS p FROM orders))
 SELECT i*3+k+2 AS c, ['low','high','average'][k+1] || CASE WHEN i > 0 THEN '_' || (i+1) ELSE '' END AS name FROM q, (SELECT unnest([0,1,2]) AS k)""")
def numbered_roles(spark, sf):
    heads = R.header_cells(landed(G.quote_sheet(spark, sf)), 2)
    return longs(R.numbered_roles(heads).select("c", "name"))


# ---- cleaning and validation -----------------------------------------------------------------------------------

_DIRTY = """d AS (SELECT 'book' || user_id AS source, event_type AS sheet, CAST(event_id AS INTEGER) AS row_ref, CASE WHEN event_id % 97 = 0 THEN 'not a date' ELSE strftime(ts, '%Y-%m-%d') END AS id, CAST(ts AS DATE) AS ts,
 event_type AS metric, CASE WHEN event_type = 'error' THEN 'note' ELSE 'price' END AS role, event_type = 'signup' AS is_estimate, CASE event_id % 11 WHEN 0 THEN 'Closed' WHEN 1 THEN '#DIV/0!' WHEN 2 THEN '  ' || printf('%.2f', value) || ' '
 WHEN 3 THEN '1,' || printf('%.2f', value) WHEN 4 THEN 'TBD' WHEN 5 THEN '-' || printf('%.2f', value) WHEN 6 THEN '' WHEN 7 THEN ' see note ' WHEN 8 THEN NULL ELSE printf('%.2f', value) END AS raw FROM events),
 k AS (SELECT *, trim(raw) AS t, lower(trim(raw)) IN ('closed','holiday','na','n/a','nil','-','--','','no trade','notrade','no data','#div/0!') AS tok, CASE WHEN regexp_full_match(trim(raw), '-?[0-9][0-9,]*\\.?[0-9]*') THEN CAST(replace(trim(raw), ',', '') AS DOUBLE) END AS num FROM d)"""
TOKENS = ("closed", "holiday", "na", "n/a", "nil", "-", "--", "", "no trade", "notrade", "no data", "#DIV/0!")


@query("clean_cells", f"WITH {_DIRTY} SELECT source, sheet, row_ref, CASE WHEN NOT tok THEN num END AS value, CASE WHEN NOT tok AND num IS NULL THEN t END AS text FROM k")
def clean_cells(spark, sf):
    return Q.cleaned(G.dirty_cells(spark, sf), TOKENS).select("source", "sheet", "row_ref", "value", "text")


@query("clean_log", f"WITH {_DIRTY}, a AS (SELECT *, CASE WHEN raw IS NULL THEN NULL WHEN tok THEN 'token_to_null' WHEN num IS NOT NULL THEN 'numeric_string_converted' WHEN t <> raw THEN 'trimmed_whitespace' END AS action FROM k) SELECT source, sheet, row_ref, metric, action, raw AS original_value FROM a WHERE action IS NOT NULL")
def clean_log(spark, sf):
    return Q.cleaning_log(Q.cleaned(G.dirty_cells(spark, sf), TOKENS)).drop("new_value")


@query("blank_rows", f"WITH {_DIRTY} SELECT source, sheet, row_ref FROM k WHERE raw IS NOT NULL AND NOT tok")
def blank_rows(spark, sf):
    return Q.without_blank_rows(Q.cleaned(G.dirty_cells(spark, sf), TOKENS)).select("source", "sheet", "row_ref")


@query("invalid_dates", f"WITH {_DIRTY} SELECT sheet, count(*) FILTER (id = 'not a date') AS invalid_dates, count(*) AS n FROM k GROUP BY 1")
def invalid_dates(spark, sf):
    return Q.with_days(G.dirty_cells(spark, sf), "id", "day").groupBy("sheet").agg(F.count_if("bad_date").alias("invalid_dates"), F.count(F.lit(1)).alias("n"))


_SCAN = f"""{_DIRTY}, sc AS (SELECT source, sheet, metric, role, count(*) AS n, count(*) FILTER (raw IS NULL OR tok) AS missing, count(*) FILTER (raw IS NOT NULL AND NOT tok AND num IS NULL) AS text_contamination,
 count(*) FILTER (num < 0 AND role = 'price') AS negative_values, min(ts) AS from_ts, max(ts) AS to_ts, count(*) FILTER (is_estimate) AS estimate_rows FROM k GROUP BY 1,2,3,4),
 du AS (SELECT source, sheet, sum(CASE WHEN n > 1 THEN n ELSE 0 END)::BIGINT AS duplicate_rows FROM (SELECT source, sheet, id, metric, count(*) AS n FROM k GROUP BY 1,2,3,4) GROUP BY 1, 2)"""


@query("validate_report", f"WITH {_SCAN} SELECT sc.*, du.duplicate_rows FROM sc JOIN du USING (source, sheet)")
def validate_report(spark, sf):
    return Q.validation_report(G.dirty_cells(spark, sf), TOKENS)


@query("issue_totals", f"WITH {_SCAN} SELECT count(*) AS sheets_validated, sum(missing + text_contamination + negative_values + duplicate_rows)::BIGINT AS total_issues FROM sc JOIN du USING (source, sheet)")
def issue_totals(spark, sf):
    return Q.issue_totals(Q.validation_report(G.dirty_cells(spark, sf), TOKENS))


@query("offending_cells", f"WITH {_DIRTY} SELECT source, sheet, row_ref, metric, CASE WHEN raw IS NOT NULL AND NOT tok AND num IS NULL THEN 'text_contamination' ELSE 'negative_value' END AS issue, raw FROM k WHERE (raw IS NOT NULL AND NOT tok AND num IS NULL) OR (num < 0 AND role = 'price')")
def offending_cells(spark, sf):
    return Q.offenders(G.dirty_cells(spark, sf), TOKENS)


@query("coverage_table", f"WITH {MARKET}, s AS (SELECT series_id, count(*) AS rows, min(ts) AS from_ts, max(ts) AS to_ts FROM market GROUP BY 1) SELECT *, 'OK' AS status FROM s UNION ALL SELECT 'NOWHERE', 0, NULL, NULL, 'data not available'")
def coverage_table(spark, sf):
    return Q.coverage_table(T.market_prices(spark, sf), T.MARKETS + ["NOWHERE"])


@query("quality_notes", f"""WITH {MARKET}, g AS (SELECT series_id, lag(ts) OVER (PARTITION BY series_id ORDER BY ts) AS f, ts AS t FROM market), d AS (SELECT *, date_diff('day', f, t) AS days FROM g WHERE date_diff('day', f, t) > 4)
 SELECT series_id, count(*) AS gaps, max(days) AS longest_days, series_id || ': ' || count(*) || ' coverage gap(s) over 4 days; the largest spans ' || max(days) || ' days (' || arg_max(f, struct_pack(a := days, b := f)) || ' to ' || arg_max(t, struct_pack(a := days, b := f)) || ')' AS note FROM d GROUP BY 1""")
def quality_notes(spark, sf):
    return longs(Q.quality_notes(T.market_prices(spark, sf), 4))


@query("full_span", f"WITH {PRICE}, {VOLUME}, u AS (SELECT * FROM price UNION ALL SELECT * FROM volume) SELECT min(ts) AS first_ts, max(ts) AS latest_ts, count(DISTINCT series_id) AS series FROM u WHERE value IS NOT NULL")
def full_span(spark, sf):
    return Q.full_span(T.prices(spark, sf).unionByName(T.volumes(spark, sf)))


@query("column_profile", """SELECT 'part' AS dataset, c AS column, ty AS type, role, (SELECT count(*) FROM part) AS rows, n AS non_null, lo AS minimum, hi AS maximum FROM (
 SELECT 'p_partkey' c, 'bigint' ty, 'unknown' role, count(p_partkey) n, min(CAST(p_partkey AS VARCHAR)) lo, max(CAST(p_partkey AS VARCHAR)) hi FROM part UNION ALL SELECT 'p_name', 'string', 'unknown', count(p_name), min(p_name), max(p_name) FROM part
 UNION ALL SELECT 'p_brand', 'string', 'unknown', count(p_brand), min(p_brand), max(p_brand) FROM part UNION ALL SELECT 'p_type', 'string', 'unknown', count(p_type), min(p_type), max(p_type) FROM part
 UNION ALL SELECT 'p_size', 'int', 'unknown', count(p_size), min(CAST(p_size AS VARCHAR)), max(CAST(p_size AS VARCHAR)) FROM part UNION ALL SELECT 'p_retailprice', 'double', 'unknown', count(p_retailprice), min(CAST(p_retailprice AS VARCHAR)), max(CAST(p_retailprice AS VARCHAR)) FROM part)""")
def column_profile(spark, sf):
    return Q.column_profile(T.read(spark, sf, "part"), "part")


@query("coerce_text", """SELECT event_id, lower(trim(event_type)) AS tidy, regexp_replace(lower(event_type || '-' || props), '[^a-z0-9]', '', 'g') AS squashed, 2024 AS year, CAST(month(ts) AS INTEGER) AS month, CAST(date_trunc('month', ts) AS DATE) AS month_start,
 false AS projected, 'Arrivals' AS bare, 45.5::DOUBLE AS bag_kg, CASE WHEN event_type = 'view' THEN 'low' ELSE 'arrivals' END AS role, lower(event_type) || '_x_1' AS slug, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def coerce_text(spark, sf):
    e = T.read(spark, sf, "events")
    label = F.concat(F.date_format("ts", "MMM"), F.lit(" "), F.date_format("ts", "yyyy"))
    header = F.lit("Arrivals (1 bag = 45.5 Kg)")
    role = coerce.column_role(F.when(F.col("event_type") == "view", "Low Price").otherwise("Total Arrivals"))
    return longs(e.select("event_id", coerce.tidy_text(F.concat(F.lit("  "), F.upper("event_type"))).alias("tidy"), coerce.squashed(F.concat_ws("-", F.upper("event_type"), "props")).alias("squashed"),
                          coerce.parse_year(label).alias("year"), coerce.parse_month(label).alias("month"), coerce.month_start(coerce.parse_year(label), coerce.parse_month(label)).alias("month_start"),
                          coerce.is_projection_label(label).alias("projected"), coerce.without_unit_clause(header).alias("bare"), coerce.bag_weight(header).alias("bag_kg"), role.alias("role"),
                          coerce.slug(F.concat(F.lit(" "), F.initcap("event_type"), F.lit(" x.1-"))).alias("slug"), F.from_json("props", "k bigint")["k"].alias("k")))
