"""Hospital cost-report analytics on Spark: DataFrame in, DataFrame out."""
