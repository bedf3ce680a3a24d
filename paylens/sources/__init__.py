"""Sources: yearly CSV files, ZIP archives, names tables, test-table bridge."""
