"""Training-data operators: formatting, extraction, deduplication, filtering and packing as Spark jobs."""
