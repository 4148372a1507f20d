"""Byte-level BPE by prefix dynamic programming.

For a byte string, ``last[i]`` is the one token that ends the BPE encoding of the
prefix of i bytes. A token t that ends at i is it exactly if t may stand right
of ``last[i - len(t)]``, that is, if BPE leaves that pair of tokens apart. The
encoding is read backwards from the end. An append goes on from the last entries,
the automaton starting one longest token before the end; after an edit, entries
before it stay, and as soon as one longest token's length of new entries equals the
old ones, shifted, all later ones are the old ones. A text under a pattern keeps such
a table for each of its pieces; after an edit, pieces are split anew from shortly
before it up to the first place where an old piece begins again.

Rows: a null text counts as empty and gives no ids; repeated rows are encoded
each for itself; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tesserakt.llm.common import buffers, chunks, trimmed

#: Pretokens whose ids a worker remembers; beyond it the memory starts anew.
CACHE_ENTRIES = 500_000
#: Pretokens, and pairs of tokens, that it still remembers when a task has ended and it may lie idle.
IDLE_ENTRIES = 50_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PrefixBPE:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: b for b, r in ranks.items()}
        self.pairs: dict[int, bool] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.matcher = ahocorasick.Automaton()
        for b, r in ranks.items():
            self.matcher.add_word(b.decode("latin-1"), (len(b), r))
        self.matcher.make_automaton()
        self.longest = max(map(len, ranks), default=1)
        #: Table entries computed so far.
        self.entries = 0

    def parts(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; itself twice for a single byte."""
        found = self.split.get(token)
        if found is None:
            pieces = [self.ranks[bytes([b])] for b in self.tokens[token]]
            while len(pieces) > 2:
                merged = [self.ranks.get(self.tokens[a] + self.tokens[b], token) for a, b in zip(pieces, pieces[1:], strict=False)]
                best = min(merged)
                if best >= token:
                    break
                at = merged.index(best)
                pieces[at : at + 2] = [best]
            found = self.split[token] = (pieces[0], pieces[1]) if len(pieces) == 2 else (token, token)
        return found

    def apart(self, left: int, right: int) -> bool:
        """Whether BPE keeps these two tokens as they are when they stand side by side."""
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        known = self.pairs[left << 32 | right] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        # Undo merges from the latest back; a merge across the border that would have come before the undone one wins.
        # A left token of equal rank is made first, so the border merge must come strictly before it, or at the latest with the right one.
        limit = float("inf")
        while True:
            joined = self.ranks.get(self.tokens[left] + self.tokens[right])
            if joined is not None and joined < limit:
                return False
            l_single, r_single = len(self.tokens[left]) == 1, len(self.tokens[right]) == 1
            if l_single and r_single:
                return True
            if r_single or (not l_single and left > right):
                limit = left
                left = self.parts(left)[1]
            else:
                limit = right + 1
                right = self.parts(right)[0]

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Entries of `last` for all prefixes that it doesn't have yet (last[0] is -1)."""
        pairs, done = self.pairs, len(last) - 1
        begin = max(done - self.longest, 0)  # no token that ends later begins before it
        for at, (n, token) in self.matcher.iter(data[begin:].decode("latin-1")):  # at one end the longest token comes first
            at += begin
            if at < done or at + 1 - n < begin:
                continue
            before = last[at + 1 - n]
            if before < 0 or pairs.get(before << 32 | token) or ((before << 32 | token) not in pairs and self.apart(before, token)):
                last.append(token)
                done = at + 1
        self.entries += len(last) - 1 - begin
        return last

    def repaired(self, data: bytes, last: list[int], start: int, end: int, size: int) -> list[int]:
        """The table after the bytes start..end of the old string became `size` new ones; `data` is the new string."""
        out, moved, same = last[: start + 1], size - (end - start), 0
        step = 4 * self.longest
        while len(out) <= len(data):
            have = len(out) - 1
            self.extend(data[: have + step], out)
            for i in range(have + 1, len(out)):
                if i < start + size or out[i] != last[i - moved]:
                    same = 0
                    continue
                same += 1
                if same >= self.longest:  # what follows rests on these entries alone
                    return out[: i + 1] + last[i + 1 - moved :]
        return out

    def read(self, last: list[int]) -> list[int]:
        out, at = [], len(last) - 1
        while at:
            out.append(last[at])
            at -= len(self.tokens[last[at]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        return self.read(self.extend(data, [-1])) if data else []


class Piece:
    """A byte string with its table of last tokens, for appends and edits."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data = bpe, data
        self.last = bpe.extend(data, [-1])

    def replace(self, start: int, end: int, new: bytes) -> Piece:
        """Put `new` in the place of the bytes start..end; only entries that change are computed, and counted in bpe.entries."""
        tail = self.data[end:]
        self.last = self.bpe.repaired(self.data[:start] + new + tail, self.last, start, end, len(new))
        self.data = self.data[:start] + new + tail
        return self

    def append(self, more: bytes) -> Piece:
        return self.replace(len(self.data), len(self.data), more)

    def ids(self) -> list[int]:
        whole = self.bpe.ranks.get(self.data)
        return [whole] if whole is not None else self.bpe.read(self.last)


class Encoded:
    """A text under a pattern, piece by piece, for appends and edits in characters."""

    #: Pieces before the edited one that are split again: a match depends on what follows it only as far as the next piece reaches.
    AGAIN = 2

    def __init__(self, bpe: PrefixBPE, pattern: str, text: str = ""):
        self.bpe, self.pattern, self.text = bpe, regex.compile(pattern), text
        found = [(m.start(), m.end()) for m in self.pattern.finditer(text)]
        self.starts = np.array([a for a, _ in found], np.int64)
        self.ends = np.array([b for _, b in found], np.int64)
        self.pieces = [Piece(bpe, text[a:b].encode()) for a, b in found]

    def edit(self, start: int, end: int, new: str) -> Encoded:
        """Replace the characters start..end."""
        moved = len(new) - (end - start)
        text = self.text[:start] + new + self.text[end:]
        first = max(int(np.searchsorted(self.ends, start, "left")) - self.AGAIN, 0)  # the first piece that is split again
        at = int(self.starts[first]) if first < len(self.starts) and self.starts[first] <= start else 0 if not first else int(self.ends[first - 1])
        found: list[tuple[int, int]] = []
        stop = len(self.pieces)  # the first old piece that stays behind the edit
        for m in self.pattern.finditer(text, at):
            if m.start() >= start + len(new):
                j = int(np.searchsorted(self.starts, m.start() - moved))
                if j < len(self.starts) and self.starts[j] == m.start() - moved and self.starts[j] >= end:
                    stop = j
                    break
            found.append((m.start(), m.end()))
        old = {int(a): k for k, a in enumerate(self.starts[first:stop].tolist(), first)}
        made = [self._piece(text, a, b, old, start, end, moved) for a, b in found]
        self.starts = np.concatenate((self.starts[:first], np.array([a for a, _ in found], np.int64), self.starts[stop:] + moved))
        self.ends = np.concatenate((self.ends[:first], np.array([b for _, b in found], np.int64), self.ends[stop:] + moved))
        self.pieces[first:stop] = made
        self.text = text
        return self

    def _piece(self, text: str, a: int, b: int, old: dict[int, int], start: int, end: int, moved: int) -> Piece:
        """The piece a..b of the new text, made from the old one that began there where there is one."""
        k = old.get(a) if a <= start else None
        if k is None:
            return Piece(self.bpe, text[a:b].encode())
        piece, stop = self.pieces[k], int(self.ends[k])
        if stop <= start and b == stop:
            return piece
        head = len(self.text[a : min(start, stop)].encode())
        if end <= stop and b == stop + moved:  # the edit lies within it
            tail = len(self.text[end:stop].encode())
            return piece.replace(head, len(piece.data) - tail, text[a:b].encode()[head : len(text[a:b].encode()) - tail])
        data = text[a:b].encode()
        head = min(head, len(data))
        return piece.replace(head, len(piece.data), data[head:])

    def append(self, more: str) -> Encoded:
        return self.edit(len(self.text), len(self.text), more)

    def ids(self) -> list[int]:
        return [i for p in self.pieces for i in p.ids()]


class _Pieces(dict):
    """Pretoken to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, bpe: PrefixBPE):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        ids = b"".join(i.to_bytes(4, "little") for i in self.bpe.encode_piece(piece.encode("utf-8")))
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def shrink(self) -> None:
        for held in (self, self.bpe.pairs):
            if len(held) > IDLE_ENTRIES:
                held.clear()


_encoders: dict[tuple[str, str], tuple[_Pieces, regex.Pattern]] = {}


def _encoder(path: str, pattern: str) -> tuple[_Pieces, regex.Pattern]:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = _Pieces(PrefixBPE(load_ranks(path))), regex.compile(pattern)
        gc.freeze()  # the tables stay for good: no need to search them for garbage
    return _encoders[path, pattern]


def encode_text(text: str | None, path: str, pattern: str) -> bytes:
    """The ids of a whole text as little-endian unsigned 32-bit integers."""
    pieces, matches = _encoder(path, pattern)
    return b"".join(map(pieces.__getitem__, matches.findall(text or "")))


def decode_ids(ids: bytes, path: str, pattern: str) -> bytes:
    tokens = _encoder(path, pattern)[0].bpe.tokens
    return b"".join(map(tokens.__getitem__, memoryview(ids).cast("I").tolist()))


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Ids (little-endian, binary), their number and digests of ids and of the decoded bytes.

    `vocabulary` is a path that every executor can open (an installed file).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _encoder(vocabulary, pattern)[0]
        tokens = pieces.bpe.tokens
        try:
            for batch in batches:
                for i, j in chunks(buffers(batch.column(1))[1]):  # never the ids of the whole batch
                    rows = []
                    for text in batch.column(1).slice(i, j - i):
                        ids = encode_text(text.as_py(), vocabulary, pattern)
                        numbers = memoryview(ids).cast("I").tolist()
                        decoded = b"".join(map(tokens.__getitem__, numbers))
                        rows.append((len(numbers), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), ids if keep_ids else None))
                    n, a, b, ids = zip(*rows, strict=True)
                    columns = [batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                    if keep_ids:
                        columns.append(pa.array(ids, pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names=names)
        finally:
            pieces.shrink()

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids
    kind = dict(docs.select(id_col).dtypes)[id_col]
    schema = f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return docs.select(id_col, text_col).mapInArrow(trimmed(run), schema)


def decode_documents(encoded: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts from ids; bytes that are no UTF-8 are replaced as Python does it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(x.as_py() or b"", vocabulary, pattern).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = dict(encoded.select(id_col).dtypes)[id_col]
    return encoded.select(id_col, ids_col).mapInArrow(run, f"{id_col} {kind}, text string")
