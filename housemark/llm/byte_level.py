"""Ids of the byte-level vocabulary for texts of any shape.

tiktoken cuts a text by a pattern and merges bytes inside each cut. Its pattern looks ahead
behind white space, with a stack that a run of about a million such characters overflows. Long
runs are therefore cut out beforehand, at the places where the pattern cuts them.
"""

import base64
import re

import public_tokenizers
import tiktoken

# The characters that the pattern's \s stands for.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"

_LONG = 1000
_RUN = re.compile(f"[{WHITE_SPACE}]{{{_LONG},}}")


class ByteLevel:
    """The vocabulary at ``path``, read from its ranks; ``special`` are whole tokens."""

    def __init__(self, path: str, special: dict[str, int] | None = None):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self._special = tuple(special or ())
        self._encoding = tiktoken.Encoding(
            path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special or {}
        )

    def encode(self, text: str) -> list[int]:
        """Ids of the whole text; strings of special tokens are these tokens."""
        if len(text) < _LONG:
            return self._encoding.encode(text, allowed_special="all")
        ids: list[int] = []
        at = 0
        for run in _RUN.finditer(text):
            end = run.end()
            if end < len(text) and not text.startswith(self._special, end):
                end -= 1  # The last one goes with what follows.
            ids += self._encoding.encode(text[at : run.start()], allowed_special="all")
            ids += self._encoding._encode_single_piece(text[run.start() : end])
            at = end
        return ids + self._encoding.encode(text[at:], allowed_special="all")
