"""Product-catalogue ETL and batch retrieval as plain Spark DataFrame jobs."""
