"""Arrow data in and out, storage descriptors, generated data."""
