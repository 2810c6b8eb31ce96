"""Token counts of documents that are edited.

A document is cut into segments at places where a pre-token always starts, so its count is the sum of
its segments' counts. The segments are the leaves of a binary tree whose nodes hold characters and
tokens below them. An edit finds the leaves it touches by going down the tree, takes in
neighbours until both ends of the region are such places again, encodes the region alone, and
renews the sums on the paths above. The rest of the document is not encoded again.

Null texts are empty. A null or empty list of edits changes nothing, nor does a null edit or one with a
null start. A null length is 0, a null text of an edit is empty, and a negative start or length counts as
0. Edits beyond the end work on what is there. Documents of any length are held one at a time. Repeated rows are counted one by
one. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrapelake.llm.tokens import PartEncoder, encoder, tokenizer_path

#: Characters of a segment, at least, where the text allows a cut.
SEGMENT_CHARS = 512


def starts_part(before: str, here: str, after: str) -> bool:
    """Whether a pre-token always starts at ``here``, a space between two other characters."""
    return here == " " and not before.isspace() and not after.isspace() and bool(before and after)


def segments(text: str, size: int = SEGMENT_CHARS) -> list[str]:
    out: list[str] = []
    start, at = 0, size
    while at < len(text) - 1:
        at = text.find(" ", at, len(text) - 1)
        if at < 0:
            break
        if starts_part(text[at - 1], " ", text[at + 1]):
            out.append(text[start:at])
            start, at = at, at + size
        else:
            at += 1
    return [*out, text[start:]]


def _counts(leaves: list[str], encode: PartEncoder) -> list[int]:
    return [len(ids) // 4 for ids in encode.encode(leaves)]


class TokenTree:
    """Segments of a text under a tree of sums. ``encoded`` counts the characters encoded by edits."""

    def __init__(
        self, leaves: list[str], counts: list[int], encode: PartEncoder, size: int = SEGMENT_CHARS
    ) -> None:
        self.encode, self.size, self.encoded = encode, size, 0
        self._build(leaves, counts)

    @classmethod
    def of(cls, texts: list[str], encode: PartEncoder, size: int = SEGMENT_CHARS) -> Iterator[TokenTree]:
        """Trees of several texts, whose segments are encoded together."""
        cut = [segments(t, size) for t in texts]
        counts = iter(_counts([leaf for leaves in cut for leaf in leaves], encode))
        for leaves in cut:
            yield cls(leaves, [next(counts) for _ in leaves], encode, size)

    def _build(self, leaves: list[str], counts: list[int]) -> None:
        self.leaves = leaves
        self.width = 1 << max(0, len(leaves) - 1).bit_length()
        pad = [0] * (self.width - len(leaves))
        self.chars = [0] * self.width + [len(x) for x in leaves] + pad
        self.tokens = [0] * self.width + counts + pad
        for i in range(self.width - 1, 0, -1):
            self._renew(i)

    def _renew(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def total(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character, and the character's place in it."""
        at = min(at, self.chars[1])
        i = 1
        while i < self.width:
            i *= 2
            if at > self.chars[i] or at == self.chars[i] and self.chars[i + 1]:
                at -= self.chars[i]
                i += 1
        return i - self.width, at

    def _cut_is_safe(self, leaf: int, region: str, left: bool) -> bool:
        """Whether the region may end beside the leaf outside of it."""
        beside = self.leaves[leaf]
        if left:
            return bool(beside) and len(region) > 1 and starts_part(beside[-1], region[0], region[1])
        return len(beside) > 1 and bool(region) and starts_part(region[-1], beside[0], beside[1])

    def edit(self, start: int, length: int, text: str) -> None:
        """Replaces ``length`` characters from ``start`` on by a text."""
        start = min(start, self.chars[1])
        length = min(length, self.chars[1] - start)
        first, at = self.find(start)
        last, end = self.find(start + length)
        region = self.leaves[first][:at] + text + self.leaves[last][end:]
        while first > 0 and not self._cut_is_safe(first - 1, region, True):
            first -= 1
            region = self.leaves[first] + region
        while last + 1 < len(self.leaves) and not self._cut_is_safe(last + 1, region, False):
            last += 1
            region += self.leaves[last]
        new = segments(region, self.size)
        counts = _counts(new, self.encode)
        self.encoded += len(region)
        if len(new) != last - first + 1:
            old = self.tokens[self.width : self.width + len(self.leaves)]
            leaves = self.leaves[:first] + new + self.leaves[last + 1 :]
            self._build(leaves, old[:first] + counts + old[last + 1 :])
            return
        touched = set()
        for i, (leaf, count) in enumerate(zip(new, counts, strict=True), first):
            self.leaves[i] = leaf
            self.chars[self.width + i], self.tokens[self.width + i] = len(leaf), count
            touched.add((self.width + i) // 2)
        while touched - {0}:
            for i in touched - {0}:
                self._renew(i)
            touched = {i // 2 for i in touched}


def edited_counts(docs: DataFrame, tokenizer: str | None = None, size: int = SEGMENT_CHARS) -> DataFrame:
    """Counts of ``docs`` (``doc_id, text, edits array<struct<start, length, text>>``) before and after
    their edits, which are applied in order: ``doc_id, n_tokens, n_tokens_after, n_chars_after,
    encoded_chars`` (those that the edits had encoded anew)."""
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                before, after, chars, encoded = [], [], [], []
                trees = TokenTree.of([t or "" for t in part["text"].to_pylist()], encode, size)
                for tree, edits in zip(trees, part["edits"].to_pylist(), strict=True):
                    before.append(tree.total())
                    for e in edits or ():
                        if e is not None and e["start"] is not None:
                            tree.edit(max(e["start"], 0), max(e["length"] or 0, 0), e["text"] or "")
                    after.append(tree.total())
                    chars.append(tree.chars[1])
                    encoded.append(tree.encoded)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], *(pa.array(x, pa.int64()) for x in (before, after, chars, encoded))],
                    ["doc_id", "n_tokens", "n_tokens_after", "n_chars_after", "encoded_chars"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text", "edits").mapInArrow(
        run,
        "doc_id bigint, n_tokens bigint, n_tokens_after bigint, n_chars_after bigint, encoded_chars bigint",
    )
