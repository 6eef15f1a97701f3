"""curatrix: cataloguing, deduplication and review of large media collections on Spark."""
