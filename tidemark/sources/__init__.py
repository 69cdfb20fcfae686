"""Readers, validation and writers of bars and results."""
