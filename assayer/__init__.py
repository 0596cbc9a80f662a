"""Profiling, quality, cleaning, exploration and querying of tables, as Spark plans."""
