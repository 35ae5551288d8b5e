"""Spark-native analytics for bar series: features, labels, regimes, backtests, scores and streams."""
