"""Composed lifecycles and the registered queries."""
