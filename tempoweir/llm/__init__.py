"""Training-data operators: filters, dedup, scans, archives and mixing."""
