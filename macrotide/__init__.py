"""Mixed-frequency time-series preparation and regime analytics on Spark."""
