"""Relational operators that Spark SQL has no single construct for."""
