"""Readers of annotations, runs and logs, and writers of selections and tables."""
