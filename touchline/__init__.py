"""Point-in-time match analytics on PySpark."""
