"""Readers and writers for the text, JSON and array formats of the data model."""
