"""Sky-field analytics on Spark."""
