"""Probabilistic forecasting and validation over daily market bars, as Spark DataFrame plans."""
