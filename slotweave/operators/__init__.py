"""Operators on DataFrames: extraction, tables, candidates, linking, evidence, filling, quality, profiles."""
