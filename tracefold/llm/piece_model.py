"""Vocabulary of a SentencePiece model file, and the units its pieces never cross."""

from __future__ import annotations

from dataclasses import dataclass, field

META = "▁"


@dataclass
class PieceModel:
    """Pieces a text may be made of, their scores, and the byte pieces for anything else."""

    path: str
    ids: dict[str, int] = field(default_factory=dict)
    score: dict[str, float] = field(default_factory=dict)
    byte_ids: list[int] = field(default_factory=list)
    unk_id: int = 0

    def __post_init__(self):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=self.path)
        n = self.lib.get_piece_size()
        self.unk_id = self.lib.unk_id()
        self.byte_ids = [i for i in range(n) if self.lib.is_byte(i)]
        for i in range(n):
            if not (self.lib.is_byte(i) or self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_unused(i)):
                piece = self.lib.id_to_piece(i)
                self.ids[piece], self.score[piece] = i, self.lib.get_score(i)
        #: Characters of no piece longer than one stand alone, so a text may be cut beside them.
        self.joining = {c for p in self.ids if len(p) > 1 for c in p}
        #: Whether pieces hold the space mark only in front: then words may be encoded apart.
        self.by_word = all(META not in p.lstrip(META) for p in self.ids)

    def other(self, char: str) -> tuple[int, ...]:
        """Ids of a character that no piece covers: its UTF-8 bytes, or the unknown id."""
        return tuple(self.byte_ids[b] for b in char.encode()) if self.byte_ids else (self.unk_id,)

    def automaton(self, value):
        import ahocorasick

        found = ahocorasick.Automaton()
        for piece in self.ids:
            found.add_word(piece, value(piece))
        found.make_automaton()
        return found

    def words(self, normal: str) -> list[str]:
        """A normalised text's units: cut before each run of space marks that follows another character."""
        if not self.by_word:
            return [normal] if normal else []
        parts = normal.split(META)
        out, marks = [parts[0]] if parts[0] else [], 0
        for p in parts[1:]:
            marks += 1
            if p:
                out.append(META * marks + p)
                marks = 0
        if marks:
            out.append(META * marks)
        return out
