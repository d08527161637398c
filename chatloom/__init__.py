"""Message knowledge analytics on Spark."""
