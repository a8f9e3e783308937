"""Exact, fast use of a public byte-level tokenizer inside tasks.

The vocabulary file and its library define the ids. Texts in Latin scripts go through
``tiktoken``, which merges by the same vocabulary (its ranks are read from that very
file: ids ascend in merge order) several times faster; both libraries split such texts
alike, special tokens in them included. All other texts, and those with very long runs of
white space, are left to ``tokenizers``.
The tests hold both to the same ids.
"""

from __future__ import annotations

import os
import re

import numpy as np

_OTHER_SCRIPT = re.compile("[^\x00-ɏ]")
_LONG_BLANK = re.compile(r"\s{1000}")       # tiktoken's matcher backtracks over runs of white space
_loaded: dict[str, "TextEncoder"] = {}


def letter_bytes() -> dict[str, int]:
    """The byte for which each character of a byte-level vocabulary stands: printable
    Latin-1 characters for themselves, those from U+0100 for the others in turn."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TextEncoder:
    """``encode(text)`` gives the ids of a whole text as a uint32 array, equal to
    ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        byte = letter_bytes()
        ranks = {bytes(byte[c] for c in t): i for t, i in self.tok.get_vocab(with_added_tokens=False).items() if t not in special}
        self.fast = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN,
                                      mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if _OTHER_SCRIPT.search(text) or _LONG_BLANK.search(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special="all")


def encoder(path: str) -> TextEncoder:
    """The worker process's encoder for a vocabulary file."""
    if path not in _loaded:
        _loaded[path] = TextEncoder(path)
    return _loaded[path]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file; it is resolved where the library is installed."""
    import public_tokenizers
    return str(public_tokenizers.path(name))
