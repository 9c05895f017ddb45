"""Relational operators over mentions, spans, edges and vertices."""
