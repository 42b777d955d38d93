"""Readers and writers for event tables, sequences, scores and run metrics."""
