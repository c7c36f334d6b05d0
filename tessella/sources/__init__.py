"""Readers that give objects from files, and writers of results."""
