"""Readers of raw agent logs and snapshots into canonical tables."""
