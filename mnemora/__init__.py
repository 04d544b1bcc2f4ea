"""Memory analytics on Spark: batch recall, consolidation, ingest and reports as DataFrame plans."""
