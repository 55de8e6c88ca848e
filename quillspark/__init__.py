"""Text-review analytics on Spark: DataFrame in, DataFrame out, no session globals."""
