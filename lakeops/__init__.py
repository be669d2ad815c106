"""lakeops: lakehouse operators as Spark DataFrame functions."""
