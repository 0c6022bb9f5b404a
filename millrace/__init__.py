"""Millrace: hybrid retrieval, text preparation and corpus operators on PySpark DataFrames."""
