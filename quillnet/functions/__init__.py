"""Column functions for sentences, tokens and company names."""
