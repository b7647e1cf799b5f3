"""The star-schema tables read as market series.

Order values by priority are the price quotes, shipped quantity the arrivals (status F the offtake), returned goods
a sparse driver with its own calendar, and parts by size class the yearly balance lines.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.series import daily, exact_sum

VARIETIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
BENCHMARK = "1-URGENT"
MARKETS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


_SCHEMAS: dict = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table; its schema is inferred from the footers once per path."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def prices(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return daily(o, F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice"), scale=2)


def quotes(spark, sf_dir) -> DataFrame:
    """Low, high and average quote of each variety and day."""
    o = read(spark, sf_dir, "orders")
    v = F.col("o_totalprice")
    return o.groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("ts")).agg(
        F.min(v).alias("low"), F.max(v).alias("high"), (exact_sum(v, 2) / F.count(v)).alias("avg"))


def market_prices(spark, sf_dir) -> DataFrame:
    """Price per market.  Orders take their customer's market in a join that adaptive execution broadcasts when the customers are
    few and splits where one customer has very many orders; then one aggregate per market and day, combined before its shuffle."""
    o = read(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("ts"), F.col("o_totalprice").cast("decimal(18,2)").alias("total"))
    place = (read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
             .select("n_nationkey", "r_name"))
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(
        place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    return (o.join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(F.col("r_name").alias("series_id"), "ts")
            .agg((F.sum("total").cast("double") / F.count("total")).alias("value")))


def supplier_prices(spark, sf_dir) -> DataFrame:
    """Unit value per supplier and day: as many series as there are suppliers."""
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").cast("string").alias("series_id"), F.to_date("l_shipdate").alias("ts")).agg(
        (exact_sum("l_extendedprice", 2) / F.sum("l_quantity")).alias("value"))


def volumes(spark, sf_dir) -> DataFrame:
    """Arrivals (everything shipped) and offtake (status F) per ship day."""
    li = read(spark, sf_dir, "lineitem")
    per_day = li.groupBy(F.to_date("l_shipdate").alias("ts")).agg(
        F.sum("l_quantity").alias("arrivals"), F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("offtake"))
    return per_day.unpivot(["ts"], ["arrivals", "offtake"], "series_id", "value").select("series_id", "ts", "value")


def arrivals(spark, sf_dir) -> DataFrame:
    return volumes(spark, sf_dir).where("series_id = 'arrivals'")


def driver(spark, sf_dir) -> DataFrame:
    """A rate with gaps and its own calendar: value per unit of the returned goods of a day."""
    li = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return li.groupBy(F.to_date("l_shipdate").alias("ts")).agg(
        (exact_sum("l_extendedprice", 2) / F.sum("l_quantity")).alias("value")).select(
        F.lit("driver").alias("series_id"), "ts", "value")


def exports(spark, sf_dir) -> DataFrame:
    """Monthly quantity of the returned goods, labelled by month start."""
    li = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return li.groupBy(F.trunc("l_shipdate", "month").alias("ts")).agg(F.sum("l_quantity").alias("value")).select(
        F.lit("exports").alias("series_id"), "ts", "value")


def balance(spark, sf_dir) -> DataFrame:
    """Yearly supply and demand lines in millions of units; the last year is only part of one, hence an estimate.

    Lines shrink to one row per part and year before the join, so one hot part cannot skew it.
    """
    li = read(spark, sf_dir, "lineitem")
    per_part = li.groupBy("l_partkey", F.year("l_shipdate").alias("year")).agg(
        F.sum("l_quantity").alias("supply"), F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("demand"))
    typed = per_part.join(read(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    per_type = typed.groupBy("p_type", "year").agg(F.sum("supply").alias("supply"), F.sum("demand").alias("demand"))
    lines = per_type.select(F.col("p_type").alias("category"), "year", F.col("supply").alias("value")).unionByName(
        per_type.groupBy("year").agg(F.sum("supply").alias("value")).select(F.lit("Total Supply").alias("category"), "year", "value")
    ).unionByName(
        per_type.groupBy("year").agg(F.sum("demand").alias("value")).select(F.lit("Total Demand").alias("category"), "year", "value"))
    last = per_type.agg(F.max("year")).scalar()
    est = F.col("year") == last
    return lines.select("category", F.when(est, F.format_string("%d(exp)", "year")).otherwise(F.col("year").cast("string")).alias("year_label"),
                        "year", (F.col("value") / 1000.0).alias("value"), est.alias("is_estimate"))
