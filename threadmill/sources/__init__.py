"""Readers, and adapters that map tables onto posts and comments."""
