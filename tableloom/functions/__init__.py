"""Column helpers and distributed statistics."""
