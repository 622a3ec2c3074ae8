"""Column functions: allocation, ids, formatting, confidence and evidence rules."""
