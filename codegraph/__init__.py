"""Code graphs and training-data operators as Spark jobs."""
