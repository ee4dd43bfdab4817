"""Streams over the same tables: page updates that keep state current, and progress of runs."""
