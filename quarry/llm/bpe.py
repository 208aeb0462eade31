"""Byte-level BPE vocabularies, as their files hold them, for work inside tasks."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import public_tokenizers

#: Runs of one kind that are so long go to the exact library: the faster reader's time and stack grow with them.
LONG_RUN = 400
_LONG = re.compile(rf"\s{{{LONG_RUN}}}|\S{{{LONG_RUN}}}")


@lru_cache(2)
def byte_of() -> dict[str, int]:
    """Byte that each printable stand-in of the vocabulary file means."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def file_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@lru_cache(2)
def ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ids of tokens by their bytes, and of the special tokens."""
    spec, byte = file_spec(path), byte_of()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return {bytes(byte[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}, special


@lru_cache(2)
def _reader(path: str):
    import tiktoken

    tokens, special = ranks(path)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens, special_tokens=special)


@lru_cache(2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode(path: str, text: str) -> np.ndarray:
    """Ids as the tokenizers library gives them, special strings in the text included."""
    if _LONG.search(text):
        return np.array(_library(path).encode(text, add_special_tokens=False).ids, np.uint32)
    return _reader(path).encode_to_numpy(text, allowed_special="all")


def encode_plain(path: str, text: str) -> np.ndarray:
    """Ids of a text without long runs; special strings are plain text."""
    return _plain(path).encode_to_numpy(text, disallowed_special=())


@lru_cache(2)
def _plain(path: str):
    import tiktoken

    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path)[0], special_tokens={})


def encode_word(path: str, word: bytes) -> np.ndarray:
    """Ids of a word behind a blank; special strings are plain text, and bytes that are no UTF-8 are taken as they are."""
    try:
        text = " " + word.decode()
    except UnicodeDecodeError:
        return np.array(_reader(path)._encode_bytes(b" " + word), np.uint32)
    if not _LONG.search(text):
        return np.array(_reader(path).encode_ordinary(text), np.uint32)
    pieces = re.split("(" + "|".join(map(re.escape, ranks(path)[1])) + ")", text)
    if len(pieces) == 1:
        return np.array(_library(path).encode(text, add_special_tokens=False).ids, np.uint32)
    return np.concatenate([encode_word_part(path, p) for p in pieces])


def encode_word_part(path: str, text: str) -> np.ndarray:
    if text in ranks(path)[1] or not _LONG.search(text):
        return np.array(_reader(path).encode_ordinary(text), np.uint32)
    return np.array(_library(path).encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(2)
def opens_word(path: str) -> np.ndarray:
    """Does a token start with a blank? By id, up to 2**16."""
    out = np.zeros(1 << 16, bool)
    for w, i in ranks(path)[0].items():
        out[i] = w[:1] == b" "
    return out
