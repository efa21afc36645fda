"""Return models. They are fitted inside grouped functions, one group for each ticker and refit."""
