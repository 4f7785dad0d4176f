"""Table-to-table jobs, grouped by kind of work."""
