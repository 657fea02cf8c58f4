"""Placing rows: materialised frames, dense positions, timings."""
