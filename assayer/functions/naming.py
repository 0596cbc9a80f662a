"""Rules over column names (metadata only, never over rows)."""

from __future__ import annotations

import re

from assayer.functions import tokens as t


def normalize_name(name: str) -> str:
    """Lower-case, runs of other characters become one underscore, no outer underscores."""
    return re.sub(r"[^a-z0-9]+", "_", str(name).strip().lower()).strip("_")


def is_identifier_name(name: str) -> bool:
    n = normalize_name(name)
    return (
        n == "id"
        or n.startswith("id_")
        or n.endswith(("_id", "_code", "_key"))
        or any(word in n for word in ("uuid", "guid"))
        or n in t.IDENTIFIER_NUMBER_NAMES
    )


def has_date_name(name: str) -> bool:
    n = normalize_name(name)
    return bool(set(n.split("_")) & set(t.DATE_WORDS)) or any(s in n for s in t.DATE_SUBSTRINGS)


def has_text_name(name: str) -> bool:
    n = normalize_name(name)
    return any(word in n for word in t.TEXT_WORDS)


def has_serial_name(name: str) -> bool:
    n = normalize_name(name)
    return any(word in n for word in t.SERIAL_WORDS)


def negatives_are_suspicious(name: str) -> bool:
    words = set(normalize_name(name).split("_"))
    return bool(words & set(t.NON_NEGATIVE_WORDS)) and not words & set(t.SIGNED_WORDS)
