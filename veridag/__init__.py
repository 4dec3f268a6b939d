"""Spark jobs over claim graphs, library texts and bibliographies."""
