"""tidemark: market time series analytics expressed as Spark plans.

Every operator takes and returns DataFrames in the long form ``(series_id, ts, value)`` and works on all series
at once.  Raw rows are consolidated to one row per series and calendar day with a map-side combined aggregate
before any window runs, so no window partition can grow past the number of days in the calendar, however many
raw rows one series has.
"""

from tidemark.config import Gates

__all__ = ["Gates"]
