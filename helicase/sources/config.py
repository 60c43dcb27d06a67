"""Settings: JSON with comment lines."""

from __future__ import annotations

import json
import re

KNOWN_LSH = {"ht": "table", "light": "light", "bloom": "bloom", "bf": "bloom"}


def parse(text: str) -> dict:
    """JSON without lines that start with #."""
    return json.loads("\n".join(x for x in text.splitlines() if not re.match(r"[ \t]*#", x)))


def lsh_kind(settings: dict) -> str:
    return KNOWN_LSH[settings.get("type", "ht")]
