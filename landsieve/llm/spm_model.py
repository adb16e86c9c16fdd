"""The parts of a sentencepiece BPE model that encoding needs."""

from __future__ import annotations

from dataclasses import dataclass

SPACE = "▁"


@dataclass(frozen=True)
class PieceVocabulary:
    """``scores`` of the ordinary pieces, by text; ``byte_ids``: the id for each byte of characters without a piece."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]


def load_vocabulary(path: str) -> PieceVocabulary:
    """Reads the pieces through the library; fails on models with traits that the encoder does not have."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, scores = {}, {}
    byte_ids = [-1] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif model.is_unused(i):
            raise ValueError("unused pieces are not supported")
        elif not model.is_control(i) and not model.is_unknown(i):
            ids[piece], scores[piece] = i, model.get_score(i)
    if min(byte_ids) < 0:
        raise ValueError("a model with byte pieces is needed")
    if any(SPACE in piece.lstrip(SPACE) for piece in ids):
        raise ValueError("pieces that reach over a word start are not supported")
    probe = " aÅﬁ①  b\t\n"
    if model.decode(model.encode(probe)) != probe or model.encode_as_pieces("a")[0] != SPACE + "a":
        raise ValueError("a model is needed that changes no characters and puts a space before the text")
    return PieceVocabulary(ids, scores, byte_ids)
