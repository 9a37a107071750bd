"""Document analytics on Spark: collections of PDF files as queryable tables."""
