"""Dataflow operators on features, kNN lists and weighted graphs.

A graph is a table of edges (i, j, w), both directions stored, zero weights absent.
"""
