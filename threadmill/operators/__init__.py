"""Operators over comments, posts, profiles, runs and events."""
