"""Readers and writers of cards, versioned tables and state."""
