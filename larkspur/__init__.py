"""larkspur: search-performance and content analytics on PySpark."""
