"""Sources and sinks of bars and fundamentals."""
