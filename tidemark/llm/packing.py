"""Cost-balanced packing of documents into sequences of a fixed token budget.

Each task tokenises its documents and packs them in groups of bounded size, so no document, token or plan leaves
its task. A document longer than a sequence gives full sequences of its own; what is left of it, and every
shorter document, is an item. In a group, the items' tokens fix the sequences: as many full ones as they fill, and
for the rest shorter ones, each a power of two, which the format doesn't pad. Items go, longest first,
to the sequence with the lowest estimated cost, ``linear * tokens + quadratic * tokens**2`` summed over its pieces
(attention within a piece), among those with room for the whole item. If none has, the item is cut over the
sequences with most room. So every sequence is filled to its end and none is padded.

Defined cases: a null or empty text is a document of one token, the end mark; repeated rows are packed one by
one; an empty table gives no pieces; a document of any length is tokenised whole and cut; of items of equal length the
one that came first goes first, of sequences of equal cost the one with the smaller number is filled; other columns
than doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

#: Fixed values of the packed format.
MAX_TOKENS, END_ID, TOKENIZER = 2048, 1, "word_bpe_49k.json"
#: Estimated cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Items packed together at most; their ids (4 bytes a token) are all that a task holds.
GROUP_ITEMS = 2048
#: Words whose ids a task remembers at most; then it starts anew.
REMEMBERED = 250_000
#: Word ends that are a token run of their own and never join the letters before.
ENDINGS = '.,;:!?"()[]{}*#$%&|<>-_/+=~@^`'

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds(dict):
    """White-space-separated word -> its ids as little-endian 32-bit bytes.

    White space ends a token in this vocabulary, so a text's ids are its words' ids in turn. Most words are letters
    with some punctuation behind; their lower-cased letters go to the vocabulary's model directly, all others
    through the whole tokenizer.
    """

    def __init__(self, file: str):
        self.whole = Tokenizer.from_file(file)
        self.model = self.whole.model
        self.parts: dict[str, bytes] = {}
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.letters = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def part(self, text: str) -> bytes:
        """Ids of one run of letters or of punctuation, already in lower case."""
        if (got := self.parts.get(text)) is None:
            if len(self.parts) >= REMEMBERED:
                self.parts.clear()
            shown = text if text.isascii() else "".join(map(self.letters.__getitem__, text.encode()))
            got = self.parts[text] = self.pack([t.id for t in self.model.tokenize(shown)])
        return got

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        core = word.rstrip(ENDINGS)
        plain = word.isascii() or (unicodedata.is_normalized("NFC", word) and "Σ" not in word and "İ" not in word)
        if core.isalpha() and plain:
            got = self.part(core.lower()) + (self.part(word[len(core) :]) if len(core) < len(word) else b"")
        else:
            got = self.pack(self.whole.encode(word, add_special_tokens=False).ids)
        self[word] = got
        return got

    def ids(self, text: str) -> bytes:
        """The text's ids and the end mark."""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))) + self.pack([END_ID])


def place(lengths: np.ndarray, room: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int]]:
    """(item, sequence, start in the item, tokens) for items of at most ``room`` tokens each.

    The sequences hold ``room`` tokens each, and the last ones the powers of two that make up the rest.
    """
    n, rest = divmod(int(lengths.sum()), room)
    left = np.array([room] * n + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1], np.int64)
    cost, out = np.zeros(len(left)), []

    def put(item: int, seq: int, start: int, tokens: int) -> None:
        left[seq] -= tokens
        cost[seq] += linear * tokens + quadratic * tokens * tokens
        out.append((item, seq, start, tokens))

    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        seq = int(np.where(left >= need, cost, np.inf).argmin())
        if left[seq] >= need:
            put(item, seq, 0, need)
            continue
        start = 0
        while start < need:
            seq = int(left.argmax())
            tokens = min(int(left[seq]), need - start)
            put(item, seq, start, tokens)
            start += tokens
    return out


def pack_documents(docs: DataFrame, max_tokens: int = MAX_TOKENS, group_items: int = GROUP_ITEMS, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, and a checksum of its ids."""
    file = tokenizer or public_tokenizers.path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(file)
        base = TaskContext.get().partitionId() << 40
        made = 0
        items: list[tuple[int | None, int, bytes, int]] = []  # doc_id, tokens before, ids, tokens of the document
        pieces: list[tuple] = []

        def piece(doc: int | None, start: int, ids: bytes, total: int, seq: int, offset: int) -> None:
            pieces.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, seq, offset))

        def close() -> None:
            nonlocal made
            filled: dict[int, int] = {}
            for i, seq, start, tokens in place(np.array([len(x[2]) // 4 for x in items], np.int64), max_tokens):
                doc, before, ids, total = items[i]
                piece(doc, before + start, ids[4 * start : 4 * (start + tokens)], total, base + made + seq, filled.get(seq, 0))
                filled[seq] = filled.get(seq, 0) + tokens
            made += max(filled, default=-1) + 1
            items.clear()

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pieces)], names=[c.split()[0] for c in SCHEMA.split(", ")])
            pieces.clear()
            return got

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = words.ids(text or "")
                total = len(ids) // 4
                whole = total - total % max_tokens
                for start in range(0, whole, max_tokens):
                    piece(doc, start, ids[4 * start : 4 * (start + max_tokens)], total, base + made, 0)
                    made += 1
                if whole < total:
                    items.append((doc, whole, ids[4 * whole :], total))
                if len(items) >= group_items:
                    close()
            if pieces:
                yield out()
        if items:
            close()
        if pieces:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
