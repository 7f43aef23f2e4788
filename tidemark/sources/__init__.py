"""Logs and snapshots as files."""
