"""Table scans, schema and shape probes."""
