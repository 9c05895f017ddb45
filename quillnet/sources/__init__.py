"""Readers of annotated markup, coreference and network files, and the writers of the latter."""
