"""Readers of trace exports and writers of results."""
