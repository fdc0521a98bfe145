"""Web-content analytics on Spark."""
