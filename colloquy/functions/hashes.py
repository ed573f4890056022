"""Keys and fingerprints: SHA-256 over canonical texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def settings_key(canonical_json: Column) -> Column:
    """The first 16 hex digits; the JSON has sorted keys and holds settings on a white list only (no API key)."""
    return F.substring(F.sha2(canonical_json, 256), 1, 16)


def quiz_id(*parts: Column) -> Column:
    """32 hex digits over session, settings, coverage, fingerprint and generator version, joined by a zero character."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 32)


def turn_text(role: Column, text: Column) -> Column:
    """A turn's part of a session fingerprint."""
    return F.concat(role, F.lit("\0"), text, F.lit("\x01"))
