"""Graphs out of GraphML files and out of tables."""
