"""Readers and writers of the record sets."""
