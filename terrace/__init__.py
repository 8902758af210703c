"""Terrace: layered knowledge graphs and the documents behind them, on Spark."""
