"""Pieces of a public SentencePiece model and what each of them costs.

The model file's scores are merge ranks, not probabilities, so a piece's cost is
that of a Zipf unigram over the ranks: round(1024 * ln(rank + 2)), whole numbers
so that ties are exact.  Of two splits of equal cost the one with fewer pieces
wins: both are folded into one integer weight, and a split's weight is the sum.
A character without a piece is spelled in byte pieces.  The space sign stands for
a space; where a text holds the sign itself, it is spelled in bytes too, so that
decoding gives back every text exactly.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

SPACE = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_ONE = 1 << 20


@dataclass(frozen=True)
class Vocabulary:
    ids: dict[str, int]
    weights: dict[str, int]
    byte_ids: tuple[int, ...]
    byte_weight: int
    longest: int


def load(path: str = DEFAULT_MODEL) -> Vocabulary:
    """Reads the model file on the driver; the result is small and travels with the tasks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size, ids, weights, byte_ids = model.get_piece_size(), {}, {}, [0] * 256
    for k in range(size):
        piece = model.id_to_piece(k)
        if model.is_byte(k):
            byte_ids[int(piece[3:5], 16)] = k
        elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
            rank = min(-model.get_score(k), size)  # pieces outside of the merges rank last
            ids[piece], weights[piece] = k, round(1024 * math.log(rank + 2)) * _ONE + 1
    return Vocabulary(ids, weights, tuple(byte_ids), round(1024 * math.log(2 * size + 2)) * _ONE + 1, max(map(len, ids)))
