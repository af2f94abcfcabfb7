"""Where the public tokenizers' files lie. Operators take the path as a parameter; only the queries ask here."""

from __future__ import annotations


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
