"""Column functions: clocks, keys, checksums."""
