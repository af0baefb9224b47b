"""The two searches, and building and using an index."""
