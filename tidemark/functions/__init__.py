"""Column-level building blocks: dates, numbers, names, thresholds, export."""
