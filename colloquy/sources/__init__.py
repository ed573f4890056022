"""Readers of conversation logs: JSON Lines, JSON, SQLite, Markdown and web exports."""
