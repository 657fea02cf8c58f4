"""Operators on keyed tables, batches, columns and rows."""
