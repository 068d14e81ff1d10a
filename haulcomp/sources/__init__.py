"""Readers and writers of survey tables and results."""
