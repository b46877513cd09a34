"""Token ids of texts by public vocabularies, loaded once per Python worker.

A ``.tiktoken`` path is read as ranks, which give the ids of the byte-level ``.json``
twin of the same vocabulary several times faster; a ``.json`` path is read by the
tokenizers library. Strings of special tokens in a text are ordinary text, or, if asked
for, the special ids that the ``.json`` file gives them, as the library does by default.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from functools import cache

import numpy as np


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def special_ids(path: str) -> dict[str, int]:
    """The special tokens of a vocabulary, from its ``.json`` file."""
    with open(path.removesuffix(".tiktoken").removesuffix(".json") + ".json", encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"] if t["special"]}


@cache
def encoder(path: str, special: bool = False) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids as unsigned 32-bit numbers; ``special`` reads strings of special tokens as such."""
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special_ids(path) if special else {})
        if special:
            return lambda text: np.array(own.encode(text, allowed_special="all"), dtype="<u4")
        return lambda text: np.array(own.encode_ordinary(text), dtype="<u4")
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.encode_special_tokens = not special
    return lambda text: np.array(loaded.encode(text, add_special_tokens=False).ids, dtype="<u4")
