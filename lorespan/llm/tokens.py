"""Token ids of whole texts, as the ``tokenizers`` library gives them for a tokenizer file.

``tiktoken`` gives the ids of byte-level BPE at four times the speed, and is used where it is proven to give the same:

* The file's merges are in the order of the ids they make, and their number is that of the tokens above bytes.
  Then both libraries always merge the pair of lowest id, but ``tiktoken`` any two pieces whose bytes are a
  token, ``tokenizers`` only the pair that the file lists for that token.
* Say they first part ways over pieces x, y whose bytes are the token t, a pair not listed. No piece lay across t's
  ends so far, so both did inside t what they do with t alone. Alone, then, one makes t of x, y and the other does not.
* So if both encode every token's own bytes alike, which is checked, they encode every text alike.

Texts that hold a string of an added token go to ``tokenizers``, as do those that the matcher of ``tiktoken`` refuses.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Fixed value: the word pattern of the byte-level pre-tokenizer.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level_model(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]], list[str]]:
    """(id of each token's bytes, merges in order, strings of added tokens) of a byte-level BPE file.

    Raises ValueError for other kinds of tokenizer.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    if not plain or model.get("type") != "BPE" or spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
        raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
    table = byte_of_char()
    raw = lambda s: bytes(table[c] for c in s)
    added = [a["content"] for a in spec.get("added_tokens", [])]
    ids = {raw(t): i for t, i in model["vocab"].items() if t not in set(added)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return ids, [(raw(a), raw(b)) for a, b in merges], added


def _tiktoken(path: str) -> tuple[tiktoken.Encoding, list[str]] | None:
    """The encoding and the strings of added tokens, where merges are in the order of ids."""
    try:
        ranks, merges, added = byte_level_model(path)
    except ValueError:
        return None
    made = [ranks.get(a + b, -1) for a, b in merges]
    if len(ranks) != 256 + len(made) or not all(x < y for x, y in zip([255, *made], made, strict=False)):
        return None
    return tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={}), added


@lru_cache(maxsize=4)
def proven(path: str) -> bool:
    """Whether ``tiktoken`` gives the ids of ``tokenizers`` for the file; a second's work, for the driver."""
    fast = _tiktoken(path)
    if fast is None:
        return False
    char = {b: c for c, b in byte_of_char().items()}
    model = Tokenizer.from_file(path).model
    return all(fast[0]._encode_single_piece(t) == [x.id for x in model.tokenize("".join(char[b] for b in t))] for t in fast[0].token_byte_values())


def vocabulary(path: str) -> int:
    """Ids of the tokenizer are below this number."""
    return 1 + max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())


class Encoder:
    """``ids(text)`` as numpy.uint32, no begin or end tokens, no truncation. ``same``: what ``proven`` says of the file."""

    def __init__(self, path: str, same: bool):
        self.path, self._exact = path, None
        self._fast, self._added = (_tiktoken(path) if same else None) or (None, [])

    def ids(self, text: str) -> np.ndarray:
        if self._fast is not None and not any(a in text for a in self._added):
            try:
                return self._fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # its matcher gives up on very long runs of white space
                pass
        if self._exact is None:
            self._exact = Tokenizer.from_file(self.path)
            self._exact.no_truncation()
            self._exact.no_padding()
        return np.array(self._exact.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str, same: bool) -> Encoder:
    """One per worker process."""
    return Encoder(path, same)
