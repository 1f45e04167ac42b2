"""wayfold: semantic path queries and corpus preparation on PySpark."""
