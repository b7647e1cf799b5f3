"""Values that have to be exactly these for results to be right."""

# Tokens that mean "no observation" in a landed cell.
MISSING_TOKENS = ["closed", "holiday", "na", "n/a", "nil", "-", "--", "", "no trade", "notrade", "no data"]

# Month labels.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

# Column role by the first matching keyword, in this order.
COLUMN_ROLES = [
    ("date", ["date", "month", "year"]),
    ("low", ["low"]),
    ("high", ["high"]),
    ("average", ["avg", "average", "mean"]),
    ("difference", ["difference", "diff", "spread"]),
    ("offtake", ["offtake", "off take"]),
    ("arrivals", ["arrival", "arrivals"]),
    ("rate", ["usd", "inr", "rate"]),
]

# Roles whose measures may not be negative.
NON_NEGATIVE_ROLES = ["price", "arrival", "area", "production", "storage_stock", "export_volume", "fx_rate",
                      "yield", "index", "computed"]

# Markers of a projected period in a header.
PROJECTION_MARKERS = ["exp", "proj", "est", "forecast", "f)"]

# Bag weight in a header such as "Arrivals 1 bag = 45 Kg".
BAG_WEIGHT_PATTERN = r"(?:1|one)?\s*bags?\s*=\s*(\d+(?:\.\d+)?)\s*(?:kgs?|kilograms?)\b"

# The same clause at the end of a header, to be removed.
UNIT_CLAUSE_PATTERN = r"(?i)[\(,]?\s*(?:1|one)?\s*bags?\s*=\s*[\d.]+\s*(?:kgs?|kilograms?)\.?\)?\s*$"

# Text that counts as a number during cleaning.
NUMERIC_TEXT_PATTERN = r"^-?[0-9][0-9,]*\.?[0-9]*$"

# Unit suffixes dropped when a cell is read as a number.
UNIT_SUFFIX_PATTERN = r"(rs\.?|inr|kg|mt|tons?|tonnes?|bags?|lakh)$"

# Observations per year by frequency.
PERIODS_PER_YEAR = {"D": 5, "W": 52, "SME": 24, "ME": 12}

# Forecast horizons in days, price lags and rolling windows of the feature table, harvest months.
HORIZONS = [7, 14, 30, 60, 90, 120, 180]
PRICE_LAGS = [1, 7, 14, 30, 90]
FEATURE_WINDOWS = [7, 30, 90]
HARVEST_MONTHS = [2, 3, 4]

# Bounds and weights of the composite scores.
SCORE_BOUNDS = {
    "momentum_roc": (-20.0, 20.0),
    "volatility_cv": (0.0, 0.10),
    "drawdown": (0.0, 80.0),
    "arrival_yoy": (-50.0, 50.0),
    "offtake_yoy": (-50.0, 50.0),
    "offtake_mom": (-20.0, 20.0),
    "arrival_ratio": (0.5, 1.5),
    "surplus": (-5.0, 5.0),
}
REGIME_SCORES = {"uptrend": 100.0, "range_bound": 50.0, "downtrend": 0.0}
COMPOSITE_WEIGHTS = {"market_strength": 0.4, "supply_pressure_inverted": 0.3, "demand": 0.2, "stability": 0.1}
LEADERSHIP_WEIGHTS = {"influence": 0.35, "dominance": 0.25, "granger": 0.25, "timing": 0.15}

# Normal quantiles of the 80 % confidence and 95 % prediction bands.
Z_CONFIDENCE = 1.2815515655446004
Z_PREDICTION = 1.959963984540054

# Published KPSS (level) critical values and their p values.
KPSS_CRITICAL = [0.347, 0.463, 0.574, 0.739]
KPSS_P = [0.10, 0.05, 0.025, 0.01]

# Published response surface (MacKinnon 1994) for the unit root p value with constant, by number of series.
TAU_STAR = [-1.61, -2.62, -3.13, -3.47, -3.78, -3.93]
TAU_MIN = [-18.83, -18.86, -23.48, -28.07, -25.96, -23.27]
TAU_MAX = [2.74, 0.92, 0.55, 0.61, 0.79, 1.0]
TAU_SMALL_P = [[2.1659, 1.4412, 0.038269], [2.92, 1.5012, 0.039796], [3.4699, 1.4856, 0.03164],
               [3.9673, 1.4777, 0.026315], [4.5509, 1.5338, 0.029545], [5.1399, 1.6036, 0.034445]]
TAU_LARGE_P = [[1.7339, 0.93202, -0.12745, -0.010368], [2.1945, 0.64695, -0.29198, -0.042377],
               [2.5893, 0.45168, -0.36529, -0.050074], [3.0387, 0.45452, -0.33666, -0.041921],
               [3.5049, 0.52098, -0.29158, -0.033468], [3.9489, 0.58933, -0.25359, -0.02721]]

# Published 5 % critical surfaces (MacKinnon 2010, constant) in 1, 1/n, 1/n^2, 1/n^3, one and two series.
CRITICAL_5 = [[-2.86154, -2.8903, -4.234, -40.04], [-3.33613, -6.1101, -6.823, 0.0]]

# Published Johansen critical values (90, 95, 99 %), constant, by number of remaining relations.
JOHANSEN_TRACE = [[2.7055, 3.8415, 6.6349], [13.4294, 15.4943, 19.9349], [27.0669, 29.7961, 35.4628],
                  [44.4929, 47.8545, 54.6815], [65.8202, 69.8189, 77.8202], [91.109, 95.7542, 104.9637]]
JOHANSEN_MAX_EIGEN = [[2.7055, 3.8415, 6.6349], [12.2971, 14.2639, 18.52], [18.8928, 21.1314, 25.865],
                      [25.1236, 27.5858, 32.7172], [31.2379, 33.8777, 39.3693], [37.2786, 40.0763, 45.8662]]

# Labels of the changes over fixed look-backs, with the days a reference may lie before its target.
CHANGE_HORIZONS = [("Previous observation", 0), ("Week on week (WoW)", 5), ("Fortnight on fortnight", 6), ("Month on month (MoM)", 10),
                   ("Quarter on quarter (QoQ)", 15), ("Year on year (YoY)", 20)]

# Labels of an influence test and of variance inflation (above the bound, the highest first, else the last).
INFLUENCE_LABELS = {"untested": "Not testable", "both": "Feedback", "one": "One-way", "none": "Independent"}
COLLINEARITY_LABELS = [(10, "Severe collinearity"), (5, "Moderate collinearity"), (None, "Acceptable")]

# Sentiment labels with their lower bounds (the last without one).
SENTIMENT_LABELS = [(0.45, "Strongly bullish"), (0.15, "Mildly bullish"), (-0.15, "Neutral"), (-0.45, "Mildly bearish"), (None, "Strongly bearish")]
