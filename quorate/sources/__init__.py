"""Readers and writers with the checks that records need."""
