"""Column-name rules. They look at names only and run on the driver."""
from __future__ import annotations

import re
from difflib import SequenceMatcher


def snake(name: str) -> str:
    """Lower case with every other character as an underscore, none at the ends."""
    return re.sub(r"[\W_]", "_", str(name).lower()).strip("_")


def compact_snake(name: str) -> str:
    """Like `snake`, with runs of underscores joined."""
    return re.sub(r"_+", "_", snake(name))


def ascii_snake(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", str(name).lower()).strip("_")


def closeness(name: str, hint: str, inside: float, shared_word: float, fuzzy: float) -> float:
    """How well a name fits a hint: 1 when equal, else the best of three weaker signs."""
    if name == hint:
        return 1.0
    signs = [SequenceMatcher(None, name, hint).ratio() * fuzzy]
    if hint in name:
        signs.append(inside)
    if set(name.split("_")) & set(hint.split("_")):
        signs.append(shared_word)
    return max(signs)


def clean_headers(names: list[str]) -> list[str]:
    """Strip blanks around headers; a header of nothing becomes ``unnamed_<position>``."""
    stripped = [str(name).strip() for name in names]
    return [name or f"unnamed_{position}" for position, name in enumerate(stripped)]
