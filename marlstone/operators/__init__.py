"""Relational operators over cell tables, metric logs and catalogues."""
