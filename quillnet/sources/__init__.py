"""Readers and writers of edit logs, graphs, assignments and features."""
