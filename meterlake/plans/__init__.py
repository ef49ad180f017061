"""Composed views: usage, capacity, agents, bookmarks, health."""
