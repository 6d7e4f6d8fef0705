"""Training-data operators: DataFrame in, DataFrame out. Nothing outside this package imports it."""
