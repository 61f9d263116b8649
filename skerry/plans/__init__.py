"""Query compilation and whole query plans."""
