"""Cutting texts into chunks that a SentencePiece model encodes independently of each other.

In a model whose pieces hold whitespace markers only at their start, no merge crosses the place before a run of
markers. The same holds around a line break that is part of no other piece. A text is therefore the chain of its
chunks: marked words, and pieces that begin with a line break. A chunk is written without its first marker, so it holds
no space: ``word`` stands for one marker and the word, '' for a marker alone, ``\\nword`` for itself.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import sentencepiece

MARK = "▁"
# A run of spaces with the word behind it, or a line break with the word behind it.
CHUNK = re.compile(r" +[^ \n]*|\n[^ \n]*")


def open_model(proto: bytes) -> sentencepiece.SentencePieceProcessor:
    """The model, after a check that texts can be cut at its markers; ValueError if not."""
    model = sentencepiece.SentencePieceProcessor(model_proto=proto)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if MARK in piece.lstrip(MARK) or ("\n" in piece and piece != "\n"):
            raise ValueError(f"piece {piece!r} crosses a chunk border")
    if model.normalize(" ﬁ  a\n") != f"{MARK * 2}ﬁ{MARK * 2}a\n":
        raise ValueError("the model changes texts before it encodes them")
    return model


def chunks(text: str) -> list[str]:
    """The chunks of a text; an empty one has none."""
    if not text:
        return []
    text = f" {text.replace(MARK, ' ')}"  # the library puts a marker before every text
    if "  " not in text:
        return text[1:].replace("\n", " \n").split(" ")
    return [c if c[0] == "\n" else c[1:].replace(" ", MARK) for c in CHUNK.findall(text)]


def encode_chunks(model: sentencepiece.SentencePieceProcessor, keys: Sequence[str]) -> list[list[int]]:
    """The ids of each chunk, as they stand inside a text."""
    mark = model.encode("\n")[:1]
    found = model.encode(list(keys), num_threads=1)
    return [(ids or mark) if key[:1] != "\n" else ids[1:] for key, ids in zip(keys, found)]


def decoded(key: str) -> str:
    """What decoding gives for a chunk inside a text: markers become spaces, bytes become their characters again.
    The library drops the space of the first marker of a text."""
    return key if key[:1] == "\n" else f" {key.replace(MARK, ' ')}"
