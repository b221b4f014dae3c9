"""Column functions: statistics over arrays, race windows and storage helpers."""
