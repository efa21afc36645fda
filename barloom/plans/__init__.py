"""Whole plans: walk-forward test, live forecast, analysis, report."""
