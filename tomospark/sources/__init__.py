"""Reading and writing scans, annotations and scan information."""
