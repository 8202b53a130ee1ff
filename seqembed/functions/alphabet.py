"""The token alphabet."""

from __future__ import annotations

from dataclasses import dataclass

# The 33-token protein alphabet; a token's id is its position.
PROTEIN_TOKENS = (
    "<cls>", "<pad>", "<eos>", "<unk>",
    "L", "A", "G", "V", "S", "E", "R", "T", "I", "D", "P", "K", "Q", "N", "F", "Y", "M", "H", "W",
    "C", "X", "B", "U", "Z", "O", ".", "-",
    "<null_1>", "<mask>",
)


@dataclass(frozen=True)
class Alphabet:
    """Tokens by id. One-character tokens are residues, the others are named specials."""

    tokens: tuple[str, ...] = PROTEIN_TOKENS
    cls: str = "<cls>"
    pad: str = "<pad>"
    eos: str = "<eos>"
    unk: str = "<unk>"

    def id_of(self, token: str) -> int:
        return self.tokens.index(token)

    @property
    def cls_id(self) -> int:
        return self.id_of(self.cls)

    @property
    def pad_id(self) -> int:
        return self.id_of(self.pad)

    @property
    def eos_id(self) -> int:
        return self.id_of(self.eos)

    @property
    def unk_id(self) -> int:
        return self.id_of(self.unk)

    def ascii_ids(self) -> list[int]:
        """Token id of each ASCII character code, the unknown id where it is no residue."""
        residues = {token: i for i, token in enumerate(self.tokens) if len(token) == 1}
        return [residues.get(chr(code), self.unk_id) for code in range(128)]


PROTEIN = Alphabet()
