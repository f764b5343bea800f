"""Spark-first analytics for marketplace listing data: DataFrame in, DataFrame out."""
