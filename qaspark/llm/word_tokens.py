"""Fast, exact use of a public lower-casing word vocabulary inside tasks.

The vocabulary's library splits a text into pieces (contractions, runs of letters, single
digits, runs of other marks) and merges each piece by itself, its last character marked as
a word's end. Texts in Latin script are split here by the same pattern, and ``tiktoken``
merges the pieces by the same vocabulary (its ids ascend in merge order): a zero byte after
each piece stands for the mark. Texts with any other character, with a zero byte or with a
special token in them go through ``tokenizers`` whole. The tests hold both ways to the same
ids.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

from .tokens import letter_bytes

#: Characters up to here are split by the pattern below; the dotted capital I, whose lower
#: case is two characters, and anything beyond go through the library.
_LAST = 0x17F
_OTHER = re.compile(f"[^\x00-{chr(_LAST)}]|İ")
WORD_END, MARK = "</w>", b"\0"


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_LAST + 1) if unicodedata.category(chr(c)).startswith(kind))


#: White space as the library's pattern knows it: the control characters and blanks that
#: Unicode lists as such.
_BLANK = "\t\n\x0b\x0c\r \x85\xa0"
_LETTER, _NUMBER = _class("L"), _class("N")
#: Fixed value: the split pattern of the vocabulary file, for lower-cased text; letters are
#: tried first, which no other part can begin with.
_PIECE = re.compile(f"[{_LETTER}]+|[{_NUMBER}]|'(?:s|t|re|ve|m|ll|d)|[^{_BLANK}{_LETTER}{_NUMBER}]+")
_ASCII_PIECE = re.compile("[a-z]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\t\n\x0b\x0c\r a-z0-9]+")
_loaded: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """``encode(text)`` gives the ids of a whole text as a uint32 array, equal to
    ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.last_id = max(self.tok.get_vocab().values())
        special = {t.content for t in self.tok.get_added_tokens_decoder().values()}
        byte = letter_bytes()
        ranks = {}
        for token, i in self.tok.get_vocab(with_added_tokens=False).items():
            if token not in special:
                end = token.endswith(WORD_END)
                key = bytes(byte[c] for c in (token[:-len(WORD_END)] if end else token)) + (MARK if end else b"")
                if key in ranks:
                    raise ValueError("a token of the vocabulary holds the byte that marks word ends")
                ranks[key] = i
        self.fast = tiktoken.Encoding(os.path.basename(path), pat_str="[^\\x00]+\\x00", mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if "<|" in text or "\0" in text or not text.isascii() and _OTHER.search(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        pieces = (_ASCII_PIECE if text.isascii() else _PIECE).findall(text.lower())
        if not pieces:
            return np.empty(0, np.uint32)
        pieces.append("")
        return np.array(self.fast.encode_ordinary("\0".join(pieces)), dtype=np.uint32)


def word_encoder(path: str) -> WordEncoder:
    """The worker process's encoder for a vocabulary file."""
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]
