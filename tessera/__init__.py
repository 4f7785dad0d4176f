"""tessera: business-record linkage, enrichment, scoring and search as PySpark jobs."""
