"""Compositions of operators: analysis modules, scores, insights, forecasts."""
