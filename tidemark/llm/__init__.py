"""Operators for preparing training data: scoring, matching, filtering, mixing, sharding and archives."""
