"""Token ids of texts, by the ``tokenizers`` library, one encoding per distinct part.

A byte-level tokenizer first cuts a text into pre-tokens and encodes each by itself. A single
space or line feed between two characters that are not white space always starts a pre-token
(the line feed is one by itself), so the ids of a text are those of the parts cut before these,
one after the other. A full stop or comma at the end of such a part, after a letter, is a
pre-token of its own as well. Most parts are common words; their ids are kept in a bounded cache.
Every part is encoded by the library itself.
"""

from __future__ import annotations

import os

import numpy as np

#: Parts whose ids a Python worker keeps; beyond that it starts over.
PART_CACHE = 900_000
_GROUP_CHARS = 4_000_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PartEncoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes | None] = {}
        # In a byte-level vocabulary every character of a token stands for one byte; added
        # tokens stand for their own text.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.bytes_of[number] = len(token)
        self.marks = {m: self._ids([m])[0].tobytes() for m in ".,"}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts that each begin where a pre-token does.

        They are encoded as one text, which is cheaper, and its ids are cut where the parts'
        bytes end.
        """
        ids = self._ids(["".join(parts)])[0]
        ends = np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in parts])
        cuts = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends, "left") + 1
        data, bounds = ids.tobytes(), [0, *(4 * cuts).tolist()]
        return [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _learn(self, pieces: set[str]) -> None:
        """Puts pieces into the cache; those that cannot be encoded by themselves as None."""
        cache = self.cache
        if len(cache) + len(pieces) > PART_CACHE:
            cache.clear()
        new = pieces.difference(cache)
        # Letters alone, as most pieces are, need no closer look.
        cores, marked = set(filter(str.isalpha, new)), []
        for piece in new.difference(cores):
            if piece[-1:] in self.marks and piece[:-1].isalpha():
                marked.append(piece)
                if piece[:-1] not in cache:
                    cores.add(piece[:-1])
                continue
            body = piece[1:] if piece[:1] == "\n" else piece
            if not body or body[0].isspace() or body[-1].isspace():
                cache[piece] = None
            elif body[-1] in self.marks and body[-2:-1].isalpha():
                marked.append(piece)
                if piece[:-1] not in cache:
                    cores.add(piece[:-1])
            else:
                cores.add(piece)
        if cores:
            listed = list(cores)
            parts = [p if p[0] == "\n" else " " + p for p in listed]
            cache.update(zip(listed, self._encode_parts(parts), strict=True))
        cache.update({p: cache[p[:-1]] + self.marks[p[-1]] for p in marked})

    def _group(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " \n").split(" ") for t in texts]
        seen: set[str] = set()
        for pieces in split:
            seen.update(pieces[1:])
        self._learn(seen)
        out: list[bytes] = []
        first = [ids.tobytes() for ids in self._ids([pieces[0] for pieces in split])]
        get = self.cache.__getitem__
        for text, pieces, head in zip(texts, split, first, strict=True):
            try:
                if pieces[0][-1:].isspace():
                    raise TypeError
                out.append(head + b"".join(map(get, pieces[1:])))
            except TypeError:  # white space beside a space or a line feed
                out.append(b"".join(ids.tobytes() for ids in self._ids(self._parts(text))))
        return out

    def _parts(self, text: str) -> list[str]:
        """The text cut before every single space between two other characters."""
        parts: list[str] = []
        for piece in text.split(" "):
            if not parts:
                parts.append(piece)
            elif piece and not piece[0].isspace() and parts[-1] and not parts[-1][-1].isspace():
                parts.append(" " + piece)
            else:
                parts[-1] += " " + piece
        return parts

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        out: list[bytes] = []
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= _GROUP_CHARS:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group) if group else out


def encoder(path: str) -> PartEncoder:
    """The worker's encoder of a tokenizer file, kept between batches and tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PartEncoder(path)
    return _ENCODERS[path]


_ENCODERS: dict[str, PartEncoder] = {}
