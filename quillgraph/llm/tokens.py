"""Token ids of whole texts by the public word BPE, fast enough for a full pass.

Ids are those of ``tokenizers.Tokenizer.encode(text, add_special_tokens=False)``.
The vocabulary's splitter never joins across white space, so a text of plain
characters is cut at white space and each distinct piece is encoded once by the
library's BPE model and kept in a bounded memo. Any text with a character
outside the plain set, or with a special token's spelling, goes through the
library's ``encode`` as a whole, and so does every text under a vocabulary whose
normaliser, splitter or model is set up in another way than ``SETUP``.
"""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np

VOCABULARY = "word_bpe_49k.json"

# Plain: white space that all parties agree on, printable ASCII, Latin-1 letters, common Latin-1 marks.
_NOT_PLAIN = re.compile("[^\\t\\n\\r\\x20-\\x7e¡¿«»À-ÖØ-öø-ÿ]")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")

# The set-up of the vocabulary file that the cut at white space holds for.
SETUP = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
MODEL_SETUP = {"type": "BPE", "dropout": None, "end_of_word_suffix": "</w>", "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}


def _byte_letters() -> dict[int, str]:
    """The byte alphabet of byte-level BPE: printable bytes stand for themselves, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Encodes texts to uint32 id arrays; one per Python worker.

    Ids are kept as packed two-byte strings, so that a text's ids are one join.
    Both memos are bounded; a full one is dropped and fills again.
    """

    def __init__(self, path: str, chunks: int = 400_000, pieces: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary need more than two bytes")
        with open(path, encoding="utf-8") as file:
            setup = json.load(file)
        self.cuts = all(setup.get(k) == v for k, v in SETUP.items()) and all(setup["model"].get(k) == v for k, v in MODEL_SETUP.items())
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.most_chunks, self.most_pieces = chunks, pieces
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model.tokenize(spelled)]
            got = struct.pack(f"<{len(ids)}H", *ids)
            if len(piece) <= 40:
                if len(self.pieces) >= self.most_pieces:
                    self.pieces.clear()
                self.pieces[piece] = got
        return got

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a run without white space; runs that are one piece are kept with the pieces only."""
        if chunk.isalpha():
            return self._piece(chunk)
        got = b"".join(map(self._piece, _PIECE.findall(chunk)))
        if len(chunk) <= 40:
            if len(self.chunks) >= self.most_chunks:
                self.chunks.clear()
            self.chunks[chunk] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        if not self.cuts or _NOT_PLAIN.search(text) or "<|" in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        whole, mixed, chunk = self.pieces.get, self.chunks.get, self._chunk
        packed = b"".join([whole(c) or mixed(c) or chunk(c) for c in text.lower().split()])
        return np.frombuffer(packed, "<u2").astype(np.uint32)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file, loaded once."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def drop_encoders() -> None:
    """Free the worker's encoders and their memos; Spark reuses a worker for later stages, which may need the memory."""
    _encoders.clear()


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
