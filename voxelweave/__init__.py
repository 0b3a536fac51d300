"""Cross-language representation analytics over measured time series, on Spark."""
