"""relrank: search-relevance analytics expressed as Spark DataFrame jobs."""
