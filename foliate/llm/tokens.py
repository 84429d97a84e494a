"""Token ids of whole texts, each distinct word encoded once.

Byte-level BPE of this family splits a text by a pattern before merging. A token never reaches over a space that
is followed by no white space, so the pieces before such spaces can be encoded apart and joined: the ids are those
of the whole text. A text with any other space is encoded whole. The same holds for a line feed between two characters
that are no white space. A run of letters, behind a space or not, is one of the pattern's parts, and so is a run
of punctuation behind it: there the merges are all that is left to do.

A text that holds an added token's content is encoded whole, too, and so is every text under a vocabulary of another kind
(a normalizer, or a pre-tokenizer that is not the plain byte-level one).

Pieces of a batch are told apart by Arrow's dictionary encoding; what their words encode to is kept in a bounded cache.
"""

from __future__ import annotations

import os
import struct
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WORDS = 200_000
#: Bytes of text that are encoded at once.
_BYTES = 8 << 20
_MARKS = ".,;:!?"
_encoders: dict[str, Encoder] = {}

#: Byte-level alphabets show printable bytes as themselves and all others as the characters from 256 on, in order.
_PLAIN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


def _shown(text: str) -> str:
    if text.isascii():
        return text.replace(" ", _SPACE)
    return text.encode("utf-8").decode("latin-1").translate(_SHOWN)


_SPACE = chr(_SHOWN[0x20])


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.parts = self._plain_bytes()
        self.merges = self.tokenizer.model.tokenize
        self.coded = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        self.words: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}
        self.line = self.whole("\n")

    def _plain_bytes(self) -> bool:
        """Whether the rules by which texts are cut here are those of the vocabulary."""
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        cut, model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        plain = isinstance(cut, ByteLevel) and not cut.add_prefix_space and cut.use_regex
        merges = isinstance(model, BPE) and not model.dropout and not model.continuing_subword_prefix and not model.end_of_word_suffix
        return plain and merges and self.tokenizer.normalizer is None

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, text: str) -> bytes:
        known = self.coded
        return b"".join([known[t.id] for t in self.merges(_shown(text))])

    def _plain(self, part: str) -> bytes:
        """Ids of what stands at the start of a line or text."""
        ids = self.plain.get(part)
        if ids is None:
            ids = self.plain[part] = self.whole(part)
        return ids

    def _spaced(self, part: str) -> bytes:
        """Ids of a part behind a space."""
        ids = self.words.get(part)
        if ids is not None:
            return ids
        core = part.rstrip(_MARKS)
        if len(core) < len(part):
            if not core.isalpha():
                return self.whole(" " + part)
            return self._spaced(core) + self._plain(part[len(core) :])
        ids = self.words[part] = self._letters(" " + part) if part.isalpha() else self.whole(" " + part)
        return ids

    def piece(self, piece: str) -> bytes:
        """Ids of a piece behind a space, which starts with no white space."""
        above, feed, below = piece.partition("\n")
        if not feed:
            return self._spaced(piece)
        if not below or below[0].isspace() or above[-1].isspace() or "\n" in below:
            return self.whole(" " + piece)
        return self._spaced(above) + self.line + self._plain(below)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; a null has none."""
        out: list[bytes] = []
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < len(texts):
            start = sizes[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(sizes, start + _BYTES, side="right")))
            out += self._encode(pc.fill_null(texts[lo:hi], ""))
            lo = hi
        return out

    def _encode(self, texts: pa.Array) -> list[bytes]:
        if not self.parts:
            return [self.whole(t) for t in texts.to_pylist()]
        if len(self.words) > _WORDS:
            self.words.clear()
        if len(self.plain) > _WORDS // 4:
            self.plain.clear()
        split = pc.split_pattern(texts, " ")
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        pieces = split.flatten()
        coded = pieces.dictionary_encode()
        found, odd = [], []
        for i, piece in enumerate(coded.dictionary.to_numpy(zero_copy_only=False).tolist()):
            if not piece or piece[0].isspace():
                odd.append(i)
                found.append(b"")
            else:
                found.append(self.piece(piece))
        which = coded.indices.to_numpy()
        ids = pa.array(found, pa.binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
        data = memoryview(ids.buffers()[2] or b"")
        slow = set()
        for content in self.added:
            slow.update(np.flatnonzero(pc.match_substring(texts, content).to_numpy(zero_copy_only=False)).tolist())
        if odd:  # a space before white space: its text is encoded whole; at a text's start there is no space
            strange = np.isin(which, odd)
            strange[bounds[:-1]] = False
            slow.update((np.searchsorted(bounds, np.flatnonzero(strange), side="right") - 1).tolist())
        heads = pieces.take(pa.array(bounds[:-1])).to_pylist()
        spans = zip(heads, ends[bounds[:-1] + 1].tolist(), ends[bounds[1:]].tolist())
        return [self.whole(texts[i].as_py()) if i in slow else self._plain(head) + data[a:b] for i, (head, a, b) in enumerate(spans)]


def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
