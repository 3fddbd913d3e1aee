"""Column expressions shared by the query plans."""
