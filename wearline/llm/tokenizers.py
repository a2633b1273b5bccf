"""Where the public tokenizer files are; the path is a parameter of everything that uses one."""

from __future__ import annotations


def content(path: str | None = None) -> str:
    """Content of a tokenizer file on the driver; by default the byte-level one of 50k tokens."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()
