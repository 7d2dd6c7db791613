"""CSV and JSON output."""
