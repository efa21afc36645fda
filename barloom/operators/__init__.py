"""Relational operators: cleaning, indicators, normalisation, fundamentals, evaluation."""
