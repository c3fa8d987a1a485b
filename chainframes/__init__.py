"""Chain data indexing and querying on PySpark."""
