"""Document analytics on Spark: ingest, retrieve, compare, check and de-duplicate corpora of long texts."""
