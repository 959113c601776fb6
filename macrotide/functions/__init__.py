"""Column functions: calendar rules and time-series steps."""
