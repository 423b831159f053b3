"""Column expressions: scalar rules, sequence functions, window scans and SQL functions."""
