"""Evidence knowledge graphs as Spark tables: build, merge, resolve and query."""
