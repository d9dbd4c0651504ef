"""Readers and writers of evidence tables."""
