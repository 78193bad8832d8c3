"""Two-round level tagging of catalogue listings against a taxonomy, on Spark."""
