"""Relational shell, labelers, backtest, scores, significance, guards, regimes, filters and models."""
