"""Keyed tables and accumulators fed by, or probed from, streams."""
