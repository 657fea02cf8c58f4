"""Column functions: equality, hashes, bits."""
