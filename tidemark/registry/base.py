"""Registration, rounding and the shared SQL fragments."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under a name, with its SQL when there is one."""
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return wrap


def rounded(df: DataFrame, digits: int = 4, **special: int) -> DataFrame:
    """Round every double column (``special`` gives its own digits per column) for exact comparison.

    A small guard is added first: sums taken in another order differ in their last bit, which would otherwise
    decide on which side an exact half is rounded.
    """
    def one(c):
        n = special.get(c, digits)
        return F.round(F.col(c) + 0.013 * 10.0 ** -n, n).alias(c)
    return df.select(*[one(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def longs(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def r(expr: str, n: int = 4) -> str:
    """The SQL side of ``rounded``; NaN becomes null and negative zero zero."""
    v = f"round(({expr})::DOUBLE + {0.013 * 10.0 ** -n:.3e}, {n})"
    return f"(CASE WHEN isnan(({expr})::DOUBLE) OR isinf(({expr})::DOUBLE) THEN NULL WHEN {v} = 0 THEN 0.0::DOUBLE ELSE {v} END)"


def student_sql(t: str, dof: str) -> str:
    """Two-sided Student p by Simpson's rule on the angle form of the density."""
    lo = f"atan(abs({t})/sqrt({dof}))"
    h = f"((pi()/2-{lo})/2000)"
    return (f"(2*exp(lgamma(({dof}+1)/2.0)-lgamma({dof}/2.0))/sqrt(pi())*{h}/3*list_sum(list_transform(range(0,2001), "
            f"lambda i: (CASE WHEN i=0 OR i=2000 THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END)*pow(cos({lo}+i*{h}), {dof}-1))))")


def f_sql(f: str, d1: str, d2: str) -> str:
    """Upper F tail by Simpson's rule on the angle form."""
    hi = f"asin(sqrt({d2}/({d2}+{d1}*{f})))"
    return (f"(2*exp(lgamma(({d1}+{d2})/2.0)-lgamma({d1}/2.0)-lgamma({d2}/2.0))*{hi}/4000/3*list_sum(list_transform(range(0,4001), "
            f"lambda i: (CASE WHEN i=0 OR i=4000 THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END)*pow(sin(i*{hi}/4000), {d2}-1)*pow(cos(i*{hi}/4000), {d1}-1))))")


# Shared definitions of the series, the SQL side of tidemark.sources.tables.
PRICE = """price AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS ts,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS value FROM orders GROUP BY 1, 2)"""
MARKET = """market AS (SELECT r_name AS series_id, CAST(o_orderdate AS DATE) AS ts,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)"""
VOLUME = """volume AS (
  SELECT 'arrivals' AS series_id, CAST(l_shipdate AS DATE) AS ts, sum(l_quantity) AS value FROM lineitem GROUP BY 2
  UNION ALL SELECT 'offtake', CAST(l_shipdate AS DATE), sum(CASE WHEN l_linestatus='F' THEN l_quantity END) FROM lineitem GROUP BY 2)"""
DRIVER = """driver AS (SELECT 'driver' AS series_id, CAST(l_shipdate AS DATE) AS ts,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / sum(l_quantity) AS value
  FROM lineitem WHERE l_returnflag='R' GROUP BY 2)"""
EXPORTS = """exports AS (SELECT 'exports' AS series_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS ts,
  sum(l_quantity) AS value FROM lineitem WHERE l_returnflag='R' GROUP BY 2)"""
BALANCE = """bt AS (SELECT p_type, year(l_shipdate) AS year, sum(l_quantity) AS s,
    sum(CASE WHEN l_linestatus='F' THEN l_quantity END) AS d FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
  bl AS (SELECT p_type AS category, year, s AS value FROM bt UNION ALL SELECT 'Total Supply', year, sum(s) FROM bt GROUP BY year
    UNION ALL SELECT 'Total Demand', year, sum(d) FROM bt GROUP BY year),
  balance AS (SELECT category, CASE WHEN year = (SELECT max(year(l_shipdate)) FROM lineitem) THEN year || '(exp)' ELSE CAST(year AS VARCHAR) END AS year_label,
    year, value/1000.0 AS value, year = (SELECT max(year(l_shipdate)) FROM lineitem) AS is_estimate FROM bl)"""
W = "(PARTITION BY series_id ORDER BY ts)"


def frame(n: int, shift: int = 0, keys: str = "series_id") -> str:
    return f"(PARTITION BY {keys} ORDER BY ts ROWS BETWEEN {n - 1 + shift} PRECEDING AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'})"


def full(fn: str, c: str, n: int, keys: str = "series_id", shift: int = 0, need: int | None = None) -> str:
    """Rolling SQL aggregate, null below the minimum count."""
    f = frame(n, shift, keys)
    return f"CASE WHEN count({c}) OVER {f} >= {need or n} THEN {fn}({c}) OVER {f} END"


# Aligned pairs, the SQL side of tidemark.operators.series.align.
PAIRS = """pr AS (SELECT p.series_id AS a, q.series_id AS b, p.ts, p.value AS x, q.value AS y FROM market p JOIN market q
  ON p.ts = q.ts AND p.series_id < q.series_id)"""
SUPPLY = """pr AS (SELECT 'arrivals' AS a, p.series_id AS b, p.ts, v.value AS x, p.value AS y FROM price p JOIN volume v
  ON p.ts = v.ts AND v.series_id = 'arrivals')"""
P = "(PARTITION BY a, b ORDER BY ts)"
