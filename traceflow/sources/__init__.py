"""Readers, writers and the attempt-log view of the test tables."""
