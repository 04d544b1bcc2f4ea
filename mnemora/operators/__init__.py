"""DataFrame operators: recall, consolidation, events, reports, ingest."""
