"""Market-style time series, event detection, research statistics and document evidence on Spark."""
