"""Scalar building blocks: coercion of landed text, scoring helpers, tail probabilities, small dense solves."""
