"""Pre-tokens of whole texts, exactly as the tokenizers library cuts them, from cached chunks.

A text is cut at blanks into chunks, and a chunk is cut by the tokenizer's own pattern once and
then remembered. Only texts in which that gives the library's result take this way: all
characters below U+0250 (where the pattern's classes and the normalizer agree with Python's, as
the tests check for each character), none of the control characters that Python alone takes for
white space, and no special string. The library itself cuts all others.
"""

from __future__ import annotations

import re
import weakref
from functools import lru_cache

import regex
from tokenizers import Tokenizer

#: Bytes of chunks or words that a worker remembers before it starts anew.
CACHE_BYTES = 96 << 20
#: What an entry takes besides its text and value: two objects, and its place in a dict.
ENTRY_BYTES = 180

_OTHER = re.compile("[\x1c-\x1f\x85\xa0\u0250-\U0010ffff]")
_SPACES = b"\x1c\x1d\x1e\x1f\x85\xa0"


def tokenizer_path(name: str) -> str:
    """Place of an installed public tokenizer; it is a parameter of every operator here."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def special_strings(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in load(path).get_added_tokens_decoder().values())


def _members(kind: str) -> str:
    """The characters of a class among those of `common` texts, lower-cased or not."""
    found = {c for code in range(0x250) for c in chr(code) + chr(code).lower()}
    return "".join(c for c in sorted(found) if regex.match(kind, c))


@lru_cache(maxsize=4)
def fast(pattern: str) -> re.Pattern:
    """A pattern that names no classes but L and N, for the standard library, which is quicker; for `common` texts only."""
    inside = {kind: _members(rf"\p{{{kind}}}") for kind in "LN"}
    parts = re.split(r"(\[[^\]]*\])", pattern)  # what stands in brackets, and the rest
    for i, part in enumerate(parts):
        for kind, members in inside.items():
            part = part.replace(rf"\p{{{kind}}}", members if i % 2 else f"[{members}]")
        parts[i] = part
    return re.compile("".join(parts))


def common(text: str) -> bool:
    """Whether all characters are below U+0250, and none of those that only Python takes for white space."""
    try:
        data = text.encode("latin-1")  # by far the fastest test, where it applies
    except UnicodeEncodeError:
        return not _OTHER.search(text)
    return len(data.translate(None, _SPACES)) == len(data)


def plain(text: str, path: str) -> bool:
    """Whether chunks give the library's own result."""
    return not any(s in text for s in special_strings(path)) and common(text)


#: Caches of this worker, and whose turn it is: an operator that starts empties those of the others.
_ALL: weakref.WeakValueDictionary[int, Chunks] = weakref.WeakValueDictionary()
_TURN: list[str] = [""]


def take_turn(owner: str) -> None:
    """What an operator calls that starts in this worker: the caches of those before it are emptied."""
    if _TURN[0] != owner:
        _TURN[0] = owner
        for other in list(_ALL.values()):
            if other.owner != owner:
                other.clear()


class Chunks(dict):
    """Chunk -> what `make` gives for it, filled on demand, up to CACHE_BYTES for each `owner` and worker."""

    def __init__(self, make, owner: str):
        super().__init__()
        self.make, self.owner, self.held = make, owner, 0
        _ALL[id(self)] = self

    def __missing__(self, chunk):
        return self.put(chunk, self.make(chunk))

    def put(self, chunk, made):
        self[chunk] = made
        self.held += len(chunk) + ENTRY_BYTES + (len(made) * (1 if isinstance(made, bytes) else 8) if hasattr(made, "__len__") else 0)
        return made

    def clear(self) -> None:
        super().clear()
        self.held = 0

    def trim(self) -> bool:
        """Between texts: empty it if it has grown too large, and the caches of operators before this one."""
        take_turn(self.owner)
        full = self.held > CACHE_BYTES
        if full:
            self.clear()
        return full
