"""Named compositions of operators."""
