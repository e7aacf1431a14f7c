"""millrace: DataFrame-first operators for analytics, data quality, lake tables and streams on stock Apache Spark."""
