"""Text, date and number coercion as Column expressions.  Nothing here leaves the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tidy_text(c) -> Column:
    """Lower case, inner white space collapsed, ends trimmed; null becomes ''."""
    text = F.lower(F.trim(F.translate(F.coalesce(_col(c), F.lit("")), " ", " ")))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def squashed(c) -> Column:
    return F.regexp_replace(tidy_text(c), "[^a-z0-9]", "")


def is_blank(c) -> Column:
    return F.trim(F.coalesce(_col(c), F.lit(""))) == ""


def cell_text(c) -> Column:
    """Label text of a cell; a whole number loses its '.0' tail."""
    text = F.trim(F.translate(F.coalesce(_col(c), F.lit("")), " ", " "))
    return F.regexp_replace(text, r"^(-?\d+)\.0+$", "$1")


def to_number(c) -> Column:
    """A cell as DOUBLE: missing tokens, unparsable text and infinities are null, never zero."""
    text = tidy_text(c)
    bare = F.regexp_replace(F.regexp_replace(text, "[,\\s₹$]", ""), fixed.UNIT_SUFFIX_PATTERN, "")
    number = F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"), bare.try_cast("double"))
    finite = F.when(F.abs(number) < float("inf"), number)
    return F.when(~text.isin(fixed.MISSING_TOKENS), finite)


def numeric_text(c) -> Column:
    """Strict reading used by cleaning: digits, separators and one point only."""
    text = F.trim(_col(c))
    return F.when(text.rlike(fixed.NUMERIC_TEXT_PATTERN), F.regexp_replace(text, ",", "").try_cast("double"))


def to_day(c, formats=("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd-MMM-yyyy", "d MMM yyyy")) -> Column:
    text = F.trim(_col(c))
    head = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1)
    parsed = [F.try_to_date(F.when(head != "", head), "yyyy-MM-dd")] + [F.try_to_date(text, f) for f in formats]
    return F.when(~tidy_text(c).isin(fixed.MISSING_TOKENS), F.coalesce(*parsed))


def parse_year(c) -> Column:
    return F.regexp_extract(_col(c), r"((?:19|20|21)\d{2})", 1).try_cast("int")


def parse_month(c) -> Column:
    """1-12 from a month label or a bare number."""
    names = F.create_map(*[F.lit(x) for i, m in enumerate(fixed.MONTHS) for x in (m, i + 1)])
    number = F.regexp_extract(tidy_text(c), r"^(\d{1,2})$", 1).try_cast("int")
    return F.coalesce(F.try_element_at(names, F.substring(tidy_text(c), 1, 3)), F.when(number.between(1, 12), number))


def month_start(year, month) -> Column:
    y, m = _col(year), _col(month)
    return F.when(y.between(1, 9999) & m.between(1, 12), F.make_date(y, m, F.lit(1)))


def is_projection_label(c) -> Column:
    text = tidy_text(c)
    hit = F.lit(False)
    for marker in fixed.PROJECTION_MARKERS:
        hit = hit | text.contains(marker)
    return hit


def without_unit_clause(c) -> Column:
    return F.regexp_replace(F.regexp_replace(cell_text(c), fixed.UNIT_CLAUSE_PATTERN, ""), r"^[ ,\-()]+|[ ,\-()]+$", "")


def bag_weight(c) -> Column:
    """Kilograms per bag if the header states it, else null: a weight is never assumed."""
    return F.regexp_extract(tidy_text(c), fixed.BAG_WEIGHT_PATTERN, 1).try_cast("double")


def column_role(c) -> Column:
    text = tidy_text(c)
    role = F.lit("unknown")
    for name, words in reversed(fixed.COLUMN_ROLES):
        hit = F.lit(False)
        for word in words:
            hit = hit | text.contains(word)
        role = F.when(hit, name).otherwise(role)
    return role


def slug(c) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(_col(c), r"[^\p{L}\p{N}]", "_"), "^_+|_+$", ""))


def scaled(c, lo: float, hi: float) -> Column:
    """Clip to [lo, hi] and map onto 0..100; null stays null."""
    x = _col(c)
    return F.when(x.isNotNull(), (F.least(F.greatest(x, F.lit(lo)), F.lit(hi)) - lo) / (hi - lo) * 100)


def clipped(c, lo: float, hi: float) -> Column:
    x = _col(c)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def present(*cols) -> Column:
    """How many of the columns hold a value."""
    return sum((_col(c).isNotNull().cast("int") for c in cols), F.lit(0))


def mean_present(*cols) -> Column:
    """Mean over the columns that hold a value; null if none does."""
    total = sum((F.coalesce(_col(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    return F.try_divide(total, present(*cols))


def strength_label(c) -> Column:
    a = F.abs(_col(c))
    return (F.when(a.isNull() | F.isnan(a), "undetermined").when(a >= 0.9, "very strong").when(a >= 0.7, "strong")
            .when(a >= 0.5, "moderate").when(a >= 0.3, "weak").otherwise("negligible"))


def significance_stars(c) -> Column:
    p = _col(c)
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").otherwise("")


def tonnes(bags, bag_kg) -> Column:
    return _col(bags) * _col(bag_kg) / 1000.0


def periods_per_year(freq) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in fixed.PERIODS_PER_YEAR.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(table, _col(freq)), F.lit(12))


def refusal(n, gate: int, reason: str):
    """The three refusal columns every statistic carries next to its value."""
    ok = _col(n) >= gate
    return [F.when(ok, "ok").otherwise("insufficient_evidence").alias("status"),
            F.when(~ok, reason).alias("reason"),
            _col(n).cast("long").alias("available_n"), F.lit(gate).cast("long").alias("required_n")]
