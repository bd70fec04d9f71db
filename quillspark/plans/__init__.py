"""End-to-end compositions of operators (each returns a lazy DataFrame)."""
