"""Input views and the registry of queries."""
