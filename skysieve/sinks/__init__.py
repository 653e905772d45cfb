"""Table, text and binary outputs."""
