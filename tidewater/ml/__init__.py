"""Models on Spark MLlib."""
