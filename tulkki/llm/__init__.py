"""Training-data operators on Spark, one module for each, with their queries in ``catalog``."""
