"""tamis: a data-quality engine made of Spark DataFrame and Structured Streaming operators."""
