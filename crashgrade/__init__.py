"""Road-accident severity analysis as Spark jobs."""
