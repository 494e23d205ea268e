"""Sequence packing by minimum bin slack.

A document's token ids (the tokenizer's, then an end id) are cut into full
windows and one remainder. Remainders gather in a buffer of bounded size inside
the task that tokenized them; for each window a subset-sum program over a bitset
of reachable fills picks the multiset of remaining lengths closest to capacity,
and backtracking through the stored bitsets gives how often each length is
taken. A filling is repeated as long as its lengths last. What does not fill a
window moves on to the next buffer, and the last rest of a task is cut into
sequences of power-of-two length, which need no padding.

Nothing is shuffled: the plan is one narrow pass, whatever the number of rows,
and a sequence never leaves its task. Sequence ids hold the partition's number
in their upper half. Recomputing a lost partition gives the same sequences.

Null and empty texts are the end id alone. Repeated rows and ids are packed as
separate documents; equal lengths are taken last come first. A very long text is cut
into full windows as it comes. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from gridlens.llm.text import as_key, exact, held, longs

CAPACITY = 4096
END_ID = 2
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def fill_window(counts: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of available lengths whose sum comes closest to `capacity` from below.

    `counts[n]` pieces of length n are there. Bit s of a row is set if s can be
    filled with the lengths so far; lengths go from long to short, each in
    binary shares of its count, and the scan ends once `capacity` is reached.
    """
    full, rows, items = (1 << (capacity + 1)) - 1, [1], []
    for n in np.flatnonzero(counts)[::-1].tolist():
        left, share = min(int(counts[n]), capacity // n), 1
        while left > 0:
            k = min(share, left)
            reach = rows[-1] | (rows[-1] << (n * k)) & full
            if reach != rows[-1]:
                items.append((n, k))
                rows.append(reach)
                if reach >> capacity & 1:
                    break
            left, share = left - k, share * 2
        else:
            continue
        break
    at, taken = rows[-1].bit_length() - 1, {}
    for (n, k), before in zip(reversed(items), reversed(rows[:-1]), strict=True):
        if not before >> at & 1:
            at -= n * k
            taken[n] = taken.get(n, 0) + k
    return taken


#: fixed value: the tokenizer's own cut of a text into pieces.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: the visible character that stands for each byte: itself, or the next one from 256 on.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_VISIBLE = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _SHOWN)}
_END = np.array([END_ID], "<u4").tobytes()


class Encoder:
    """Ids of whole texts, as little-endian uint32.

    White space only separates words for this tokenizer, so the ids of a text are
    those of its words on end. Each different word is cut into pieces once and
    each different piece is encoded once; both memories are bounded. Words with
    characters beyond plain Latin go to the tokenizer as they are.
    """

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.tool, self.most, self.words, self.pieces = Tokenizer.from_file(path), most, {}, {}

    def _piece(self, piece: str) -> bytes:
        text = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_VISIBLE)
        self.pieces[piece] = found = b"".join([t.id.to_bytes(4, "little") for t in self.tool.model.tokenize(text)])
        return found

    def _word(self, word: str) -> bytes:
        pieces = self.pieces
        if len(pieces) >= self.most:
            pieces.clear()
        low = word.lower()
        if low.isascii() and low[:-1].isalpha():
            if low.isalpha():
                return pieces[low] if low in pieces else self._piece(low)
            if low[-1] in ".,":
                word, dot = low[:-1], low[-1]
                return (pieces[word] if word in pieces else self._piece(word)) + (pieces[dot] if dot in pieces else self._piece(dot))
        if not word.isprintable() or max(word, default="") >= "\u0250":
            return np.array(self.tool.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join([pieces[p] if p in pieces else self._piece(p) for p in PIECE.findall(low)])

    def __call__(self, text: str | None) -> np.ndarray:
        if not isinstance(text, str):
            return np.frombuffer(_END, "<u4")
        if "<|" in text:  # perhaps a special token's string
            return np.array([*self.tool.encode(text, add_special_tokens=False).ids, END_ID], "<u4")
        words, known = text.replace("\n", " ").split(" "), self.words
        try:
            ids = b"".join([known[w] for w in words])
        except KeyError:
            if len(known) >= self.most:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = self._word(w)
            ids = b"".join([known[w] for w in words])
        return np.frombuffer(ids + _END, "<u4")


def encoder(path: str) -> Encoder:
    """One for each Python worker, until a task of another operator comes: later tasks find the words of earlier ones."""
    return held(("encoder", path), lambda: Encoder(path))


class Packer:
    """Fills windows from a bounded buffer of remainders."""

    def __init__(self, capacity: int, held_tokens: int, base: int):
        self.capacity, self.most, self.next = capacity, held_tokens, base
        self.held: list[list] = [[] for _ in range(capacity)]
        self.counts, self.tokens, self.out = np.zeros(capacity, np.int64), 0, []

    def add(self, doc, ids: np.ndarray) -> None:
        n, c = len(ids), self.capacity
        for start in range(0, n - n % c, c):
            self._emit([(doc, start, ids[start : start + c], n)])
        if rest := n % c:
            self._hold(doc, n - rest, ids[n - rest :], n)
            if self.tokens >= self.most:
                self.drain()

    def drain(self, last: bool = False) -> None:
        """Fill windows as long as the tokens last; on the last call, empty the buffer.

        If no multiset fills the window, the closest one is taken and a further
        piece is cut for the gap.
        """
        while self.tokens >= self.capacity:
            taken = fill_window(self.counts, self.capacity)
            gap = self.capacity - sum(n * k for n, k in taken.items())
            for _ in range(1 if gap else min(int(self.counts[n]) // k for n, k in taken.items())):
                row = [self._take(n) for n, k in taken.items() for _ in range(k)]
                if gap:
                    doc, start, ids, n = self._take(int(np.flatnonzero(self.counts)[-1]))
                    row.append((doc, start, ids[:gap], n))
                    self._hold(doc, start + gap, ids[gap:], n)
                self._emit(row)
        if last:
            self._tail([self._take(n) for n in np.flatnonzero(self.counts)[::-1].tolist() for _ in range(int(self.counts[n]))])

    def _hold(self, doc, start: int, ids: np.ndarray, n: int) -> None:
        self.held[len(ids)].append((doc, start, ids, n))
        self.counts[len(ids)] += 1
        self.tokens += len(ids)

    def _take(self, n: int) -> tuple:
        self.counts[n] -= 1
        self.tokens -= n
        return self.held[n].pop()

    def _tail(self, pieces: list[tuple]) -> None:
        """Cut the last tokens into windows of power-of-two length, largest first."""
        left = sum(len(p[2]) for p in pieces)
        while left:
            room, row = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                doc, start, ids, n = pieces.pop()
                if len(ids) > room:
                    pieces.append((doc, start + room, ids[room:], n))
                    ids = ids[:room]
                row.append((doc, start, ids, n))
                room -= len(ids)
            self._emit(row)

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, n in pieces:
            self.out.append((doc, start, len(ids), ids.tobytes(), n, self.next, at))
            at += len(ids)
        self.next += 1


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, held_tokens: int = 2_000_000) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    `tokenizer` is the path of the vocabulary file on the executors. A task holds
    at most `held_tokens` tokens and the text in its current batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, packer = encoder(tokenizer), Packer(capacity, held_tokens, TaskContext.get().partitionId() << 32)

        def rows() -> pd.DataFrame:
            found, packer.out = packer.out, []
            frame = pd.DataFrame([x[1:] for x in found], columns=["start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            frame.insert(0, "doc_id", longs([x[0] for x in found]))
            return frame

        for batch in batches:
            for doc, text in zip(exact(batch["doc_id"]), batch["text"], strict=True):
                packer.add(doc, encode(text))
                if len(packer.out) >= 4000:
                    yield rows()
        packer.drain(last=True)
        if packer.out:
            yield rows()

    return docs.select(as_key(docs[id_col]).alias("doc_id"), docs[text_col].alias("text")).mapInPandas(run, PIECES)
