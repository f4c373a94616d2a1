"""Training-data operators on Spark; nothing outside this package imports it."""
