"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

Merging pairs of symbols by piece score, best first and leftmost on ties, leaves a sequence in which every two
neighbours would come out unchanged if their text were merged alone, and only one sequence has that property. So a
text is encoded from the left: an Aho-Corasick automaton gives the longest piece at the position, the piece is taken
if it is compatible with the one before (their joint text, merged again, gives the same two pieces), else the next
shorter one is tried. Where none fits, the position is marked as failed in a bitfield and the piece before is cut.

Before that a text is cut where no piece can reach across: in front of white space that follows anything else, and
between characters that stand side by side in no piece. What is left between the cuts is short and repeats, so a
worker remembers it. Runs of white space, whose pieces all have one score, are merged directly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import filterfalse

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyfold.llm.common import map_stream

SPACE = "▁"
KEPT = 400_000  # units that a worker remembers, twice: what the older half holds comes over when it is met
SHORT = 64  # characters that are merged without a heap
NEVER = float("-inf")


class Pieces:
    """Encoder and decoder of one merge-type model with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.score, self.bytes, self.text = {}, {}, {}, {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.ids[piece], self.score[piece], self.text[i] = i, model.get_score(i), piece
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.beside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids), "") for p in self.ids}  # the longest piece that begins it
        self.single = frozenset(p for p in self.ids if len(p) == 1)
        self.shown = {i: p.replace(SPACE, " ") for p, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[str, ...]] = {}
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.kind = "<u2" if model.get_piece_size() <= 1 << 16 else "<u4"
        self.names = [str(i) for i in range(model.get_piece_size())]

    # --- encoding ---

    def merged(self, text: str) -> tuple[str, ...]:
        """The pieces by merging neighbours: best score first, leftmost on ties."""
        if len(text) > SHORT:
            return self._merged_long(text)
        score = self.score.get
        sym = list(text)
        of = [score(a + b, NEVER) for a, b in zip(sym, sym[1:])]
        while of and (best := max(of)) > NEVER:
            i = of.index(best)
            sym[i : i + 2] = [sym[i] + sym[i + 1]]
            del of[i]
            if i < len(of):
                of[i] = score(sym[i] + sym[i + 1], NEVER)
            if i:
                of[i - 1] = score(sym[i - 1] + sym[i], NEVER)
        return tuple(sym)

    def _merged_long(self, text: str) -> tuple[str, ...]:
        sym, nxt, prv = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        score = self.score
        heap = [(-score[p], i, p) for i, p in ((i, sym[i] + sym[i + 1]) for i in range(len(sym) - 1)) if p in score]
        heapify(heap)
        while heap:
            _, i, p = heappop(heap)
            j = nxt[i] if sym[i] else len(sym)
            if j >= len(sym) or sym[i] + sym[j] != p:
                continue
            sym[i], sym[j] = p, ""
            nxt[i] = k = nxt[j]
            if k < len(sym):
                prv[k] = i
                if (q := p + sym[k]) in score:
                    heappush(heap, (-score[q], i, q))
            if (h := prv[i]) >= 0 and (q := sym[h] + p) in score:
                heappush(heap, (-score[q], h, q))
        return tuple(s for s in sym if s)

    def compatible(self, a: str, b: str) -> bool:
        """Whether two neighbours stay as they are when their text is merged again."""
        key = (a, b)
        if key not in self.fits:
            if len(self.fits) > 4 * KEPT:
                self.fits.clear()
            self.fits[key] = self.merged(a + b) == key
        return self.fits[key]

    def backtracked(self, text: str) -> tuple[str, ...]:
        """The pieces of a text, which is longer than a character only if all its characters are pieces."""
        n, longest, shorter, fits = len(text), self.automaton.iter_long, self.shorter, self.fits
        failed, out, at = 0, [], 0  # failed: bit i is set if nothing fits from i on
        p = next(longest(text, 0))[1]
        while True:
            while p and (failed >> (at + len(p)) & 1 or out and not (ok if (ok := fits.get((out[-1], p))) is not None else self.compatible(out[-1], p))):
                p = shorter[p]
            if p:
                out.append(p)
                at += len(p)
                if at == n:
                    return tuple(out)
                p = next(longest(text, at))[1]
            elif out:
                failed |= 1 << at
                p = out.pop()
                at -= len(p)
                p = shorter[p]
            else:
                raise ValueError(f"no pieces fit {text!r}")

    def _piece(self, text: str) -> tuple[str, ...]:
        """The pieces of a stretch that no cut divides."""
        got = self.known.get(text)
        if got is None:
            if len(text) == 1:
                got = (text,)
            elif not text.strip(SPACE):
                got = self.merged(text)
            else:
                got = self.backtracked(text)
            if len(self.known) > KEPT:
                self.known.clear()
            self.known[text] = got
        return got

    def _unit(self, unit: str) -> list[str]:
        """The pieces of a unit: white space, then anything else.

        All merges inside the word come before any merge of white space alone, so only the last space can join it.
        """
        word = unit.lstrip(SPACE)
        spaces = len(unit) - len(word)
        out: list[str] = []
        if word:
            text = SPACE + word if spaces else word
            at, beside = 0, self.beside
            for k in range(1, 1 if word.isalpha() and self.single.issuperset(word) else len(text)):
                if text[k - 1 : k + 1] not in beside:
                    out += self._piece(text[at:k])
                    at = k
            out += self._piece(text[at:])
            if spaces:
                spaces -= 1
                if spaces and out[0] == SPACE:
                    spaces, out = spaces + 1, out[1:]
        return [*self._piece(SPACE * spaces), *out] if spaces else out

    def _part(self, unit: str) -> bytes:
        """The packed ids of a unit."""
        ids: list[int] = []
        for p in self._unit(unit):
            i = self.ids.get(p)
            ids += (i,) if i is not None else map(self.bytes.__getitem__, p.encode())
        return np.array(ids, self.kind).tobytes()

    def packed(self, text: str | None) -> bytes:
        """The ids of a whole text, packed; null and the empty text have none."""
        if not text:
            return b""
        words = text.replace(SPACE, " ").split(" ")
        if not all(words):  # several spaces in a row, or at an end: they go to the word behind them
            units, n = [], 0
            for w in words[:-1]:
                n += 1
                if w:
                    units.append(" " * n + w)
                    n = 0
            units.append(" " * (n + 1) + words[-1])
            words = units
        if len(self.parts) > KEPT:
            self.older, self.parts = self.parts, {}
        parts, older = self.parts, self.older
        for w in set(filterfalse(parts.__contains__, words)):
            parts[w] = older.get(w) or self._part(w.replace(" ", SPACE) if w[0] == " " else SPACE + w)
        return b"".join(map(parts.__getitem__, words))

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text."""
        return np.frombuffer(self.packed(text), self.kind).tolist()

    # --- decoding ---

    def decoded(self, ids: list[int]) -> str:
        """The text of ids as it stands, the space in front included; bytes that are no characters become U+FFFD."""
        shown = self.shown
        try:
            return "".join([shown[i] for i in ids])
        except KeyError:  # bytes among them
            pass
        out, held = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                out.append(_characters(held))
                held = bytearray()
            out.append(shown.get(i, ""))
        if held:
            out.append(_characters(held))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids without the space that encoding puts in front."""
        text = self.decoded(ids)
        return text[1:] if ids and self.text.get(ids[0], "").startswith(SPACE) else text

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, ids joined by commas, the text that those ids decode to)."""
        ids = self.encode(text)
        return len(ids), ",".join(map(self.names.__getitem__, ids)), self.decode(ids)


def _characters(held: bytes | bytearray) -> str:
    """UTF-8 with each byte that belongs to no character as one U+FFFD."""
    try:
        return held.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(held):
        for n in (1, 2, 3, 4):
            try:
                out.append(held[at : at + n].decode())
                break
            except UnicodeDecodeError:
                n = 1
        else:
            out.append("�")
        at += n
    return "".join(out)


_MODELS: dict[str, Pieces] = {}  # a worker's, kept from task to task


def model(path: str) -> Pieces:
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text as an array; a null or empty text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        m = model(path)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield {"doc_id": part.column(0), "ids": [m.encode(t) for t in part.column(1).to_pylist()]}

    return map_stream(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        m = model(path)
        for b in batches:
            yield {"doc_id": b.column(0), "text": [m.decode(x or []) for x in b.column(1).to_pylist()]}

    return map_stream(tokens.select("doc_id", "ids"), run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: the whole text is encoded, and its whole ids are decoded.

    The hashes are of the ids in decimal joined by commas and of the decoded text in UTF-8. A null or empty text
    has no ids and the hash of nothing; repeated rows stay; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        m, sha = model(path), hashlib.sha256
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                rows = [m.digests(t) for t in part.column(1).to_pylist()]
                yield {
                    "doc_id": part.column(0), "n_tokens": [r[0] for r in rows],
                    "ids_sha256": [sha(r[1].encode()).hexdigest() for r in rows], "decoded_sha256": [sha(r[2].encode()).hexdigest() for r in rows],
                }

    return map_stream(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
