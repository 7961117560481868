"""Daily market panels on PySpark."""
