"""Encoders and token bytes of the public vocabularies, one of each per Python
worker."""

from __future__ import annotations

import base64
import functools

# The special token that the byte-level vocabulary names.
SPECIAL = {"<|endoftext|>": 50256}


def sibling(path: str, suffix: str) -> str:
    """The same vocabulary in the other file format."""
    return f"{path.rsplit('.', 1)[0]}.{suffix}"


@functools.cache
def _ranks(path: str) -> dict[bytes, int]:
    with open(sibling(path, "tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def _fast(path: str):
    import public_tokenizers
    import tiktoken
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(path), special_tokens=SPECIAL)


@functools.cache
def _whole(path: str, special: bool):
    from tokenizers import Tokenizer
    out = Tokenizer.from_file(sibling(path, "json"))
    out.encode_special_tokens = not special
    return out


def byte_ids(path: str, text: str, special: bool = True) -> list[int]:
    """Ids of a byte-level vocabulary, which lies beside ``path`` as ``.json``
    and as ``.tiktoken``.  The rank file's reader gives the same ids three times
    as fast; its pattern overflows on white space of some 100,000 characters in
    one run, and such a text goes through the JSON file's reader.  ``special``:
    the special token's string in a text is that token."""
    try:
        return _fast(path).encode(text, allowed_special="all" if special else set(), disallowed_special=())
    except ValueError:
        return _whole(path, special).encode(text, add_special_tokens=False).ids


@functools.cache
def byte_table(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary."""
    ranks = _ranks(path)
    out = [b""] * (1 + max([*ranks.values(), *SPECIAL.values()]))
    for token, i in ranks.items():
        out[i] = token
    for token, i in SPECIAL.items():
        out[i] = token.encode()
    return out


@functools.cache
def pieces(path: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.cache
def piece_table(path: str) -> list[bytes]:
    """The bytes of every id of a piece vocabulary: U+2581 is a space, and a
    byte piece its byte."""
    model = pieces(path)
    return [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i)
            else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]
