"""Names and places of downloaded files."""

from __future__ import annotations

import os
import re

MOST_NAME = 120


def safe_name(name: str, fallback: str = "file") -> str:
    """A file name without folders, control characters and leading dots."""
    clean = re.sub(r"[\x00-\x1f<>:\"/\\|?*]+", "_", name.replace("\\", "/").split("/")[-1]).strip(" .")
    if len(clean) > MOST_NAME:
        stem, ext = os.path.splitext(clean)
        clean = stem[: MOST_NAME - len(ext)] + ext
    return clean or fallback


def unique_names(names: list[str]) -> list[str]:
    """Each name once, case aside; later ones get a number before their ending."""
    taken: set[str] = set()
    out = []
    for name in map(safe_name, names):
        stem, ext = os.path.splitext(name)
        n, own = 1, name
        while own.lower() in taken:
            n += 1
            own = f"{stem}-{n}{ext}"
        taken.add(own.lower())
        out.append(own)
    return out


def place_under(folder: str, name: str) -> str:
    """The path of a file in a folder; raises ValueError if it would lie outside."""
    base = os.path.realpath(folder)
    path = os.path.realpath(os.path.join(base, name))
    if os.path.commonpath([base, path]) != base or path == base:
        raise ValueError("outside of the folder")
    return path
