"""Live tables and file-driven refreshes."""
