"""Table scans and binary formats."""
