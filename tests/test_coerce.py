from pyspark.sql import functions as F

from tidemark.functions import coerce


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn("v").alias("x")).first()["x"]


def test_numbers_and_missing_tokens(spark):
    for text, want in [("1,234.5", 1234.5), ("Closed", None), (" closed ", None), ("-", None), ("Rs 5", None), ("₹ 1,200", 1200.0), ("45 kg", 45.0), ("-20", -20.0),
                       ("TBD", None), ("", None), ("1e400", None), ("12 tonnes", 12.0), (None, None)]:
        assert one(spark, text, coerce.to_number) == want, text


def test_strict_numeric_text(spark):
    for text, want in [("110", 110.0), ("1,000", 1000.0), ("-5.5", -5.5), ("5 kg", None), ("TBD", None), ("1.", 1.0)]:
        assert one(spark, text, coerce.numeric_text) == want, text


def test_dates_years_months(spark):
    assert str(one(spark, "2024-02-29 00:00:00", coerce.to_day)) == "2024-02-29"
    assert str(one(spark, "05-Mar-2024", coerce.to_day)) == "2024-03-05"
    assert one(spark, "not a date", coerce.to_day) is None
    assert one(spark, "2026(exp)", coerce.parse_year) == 2026
    assert one(spark, "January", coerce.parse_month) == 1
    assert one(spark, "12", coerce.parse_month) == 12
    assert one(spark, "13", coerce.parse_month) is None


def test_headers(spark):
    assert one(spark, "Arrival(Bags) 1 bag=40 kg", coerce.bag_weight) == 40.0
    assert one(spark, "Offtake one bag = 45 Kg", coerce.bag_weight) == 45.0
    assert one(spark, "Arrivals", coerce.bag_weight) is None
    assert one(spark, "Arrivals (1 bag = 45 Kg)", coerce.without_unit_clause) == "Arrivals"
    assert one(spark, "Average price", coerce.column_role) == "average"
    assert one(spark, "Low price", coerce.column_role) == "low"
    assert one(spark, "2026(exp)", coerce.is_projection_label) is True
    assert one(spark, "Price & Arrivals", coerce.slug) == "price___arrivals"
    assert one(spark, "5531.0", coerce.cell_text) == "5531"


def test_missing_parts_are_left_out(spark):
    r = spark.sql("select double(null) a, 50D b, 100D c").select(coerce.mean_present("a", "b", "c").alias("m"), coerce.scaled("a", 0, 1).alias("s"), coerce.scaled(F.lit(30.0), -20, 20).alias("t"),
                                                                coerce.strength_label("a").alias("l")).first()
    assert (r.m, r.s, r.t, r.l) == (75.0, None, 100.0, "undetermined")
