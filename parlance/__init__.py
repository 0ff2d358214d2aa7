"""Speech-transcript analytics as Spark DataFrame and Structured Streaming operators."""
