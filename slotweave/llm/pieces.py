"""SentencePiece encoding and decoding of merge-type vocabularies, exact, by backtracking.

A token sequence is what merging gives if and only if each token is what merging makes of its own text and each
two neighbours are what merging makes of theirs together. So a chunk is encoded from the left with the longest
piece that starts at each position (all matches come from one Aho-Corasick pass), a neighbour is checked by
merging the two pieces' text again, shorter prefixes are tried where the check fails, and a bit field remembers
the positions from which no way leads to the end. Characters without a piece become byte pieces.

A piece never holds white space after another character, so a text falls into independent chunks, each a run of
spaces and what follows up to the next. Runs longer than one space have the lowest scores, all the same, and
are merged last, leftmost first. Chunks are remembered, in a memo of bounded size, for the life of a worker.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.llm.common import small_batches, text_udf

SPACE = "▁"
MEMO_CHUNKS, MEMO_CHARS = 400_000, 48
MEMO_PAIRS = 500_000
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*")


class PieceCodec:
    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: list[str | None] = []
        self.bytes: dict[int, int] = {}
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.runs: dict[int, int] = {}
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            self.pieces.append(None if model.is_control(i) or model.is_unknown(i) else piece)
            if model.is_byte(i):
                self.bytes[i] = int(piece[1:-1], 16)
            elif self.pieces[-1] is not None and not model.is_unused(i):
                if len(piece) > 1 and not piece.strip(SPACE):
                    self.runs[len(piece)] = i
                else:
                    self.ids[piece] = i
                    self.score[piece] = model.get_score(i)
        self.byte_id = {b: i for i, b in self.bytes.items()}
        low = [model.get_score(i) for i in self.runs.values()]
        probe = " a  ﬁÅ\t"
        if (any(SPACE in p[1:] for p in self.ids) or len(set(low)) > 1 or low and max(low) >= min(v for p, v in self.score.items() if len(p) > 1)
                or any(c not in self.ids for p in self.ids for c in p) or len(self.byte_id) != 256
                or model.normalize(probe) != self.normalized(probe)):
            raise ValueError(f"{path}: not a merge-type model with byte fallback, plain text and pieces that start words")
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) > 1:  # every known character is a piece by itself
                self.automaton.add_word(piece, (len(piece) - 1, piece))
        self.automaton.make_automaton()
        self.unknown = re.compile(f"[^{''.join(map(re.escape, sorted(p for p in self.ids if len(p) == 1)))}]")
        self.written = {piece: str(i) for piece, i in self.ids.items()}
        self._prefix: dict[str, str | None] = {}
        self._halves: dict[str, tuple[str, str] | None] = {}
        self._fits: dict[tuple[str, str], bool] = {}
        self._runs = lru_cache(4096)(self._merge_run)

    @staticmethod
    def normalized(text: str) -> str:
        return (" " + text).replace(" ", SPACE) if text else ""

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Plain merging: again and again the neighbours whose union has the best score, leftmost first.

        Also gives the two parts that were merged last.
        """
        parts, score, last = list(text), self.score, None
        while len(parts) > 1:
            best, at = max((score.get(a + b, float("-inf")), -i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == float("-inf"):
                break
            last = parts[-at], parts[1 - at]
            parts[-at:2 - at] = ["".join(last)]
        return parts, last

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts a piece is merged from; none for one character, and for what merging never makes."""
        if piece not in self._halves:
            parts, last = self.merged(piece)
            self._halves[piece] = last if len(parts) == 1 else None
        return self._halves[piece]

    def fits(self, left: str, right: str) -> bool:
        """Whether merging the text of both pieces gives just these two; with an empty left: gives the right one."""
        if len(right) > 1 and self.halves(right) is None or len(left) > 1 and self.halves(left) is None:
            return False
        if not left:
            return True
        score, now, later, ties = self.score, 0.0, float("-inf"), False
        while True:
            # Back in time: would the parts that then stood at the border have been merged before the step undone?
            now = score.get(left + right)
            if now is not None and (now > later or ties and now == later):
                return False
            if len(left) == 1 and len(right) == 1:
                return True
            if len(right) == 1 or len(left) > 1 and score[left] < score[right]:
                later, ties, left = score[left], False, self.halves(left)[1]
            else:  # of equal scores the left one came first, so the right one is undone first
                later, ties, right = score[right], True, self.halves(right)[0]

    def shorter(self, piece: str) -> str | None:
        """The longest piece that is a proper prefix."""
        if piece not in self._prefix:
            self._prefix[piece] = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.ids), None)
        return self._prefix[piece]

    def _known(self, text: str) -> list[str]:
        """Pieces of a text without unknown characters."""
        size = len(text)
        longest: list[str | None] = list(text)
        for end, (back, piece) in self.automaton.iter(text):
            longest[end - back] = piece  # ends ascend, so the last one is the longest
        failed = bytearray(size + 1)
        fits, prefix, out = self._fits, self._prefix, []
        at, piece, last = 0, longest[0], ""
        while at < size:
            while piece is not None:
                if not failed[at + len(piece)]:
                    fit = fits.get((last, piece))
                    if fit is None:
                        if len(fits) >= MEMO_PAIRS:
                            fits.clear()
                        fit = fits[last, piece] = self.fits(last, piece)
                    if fit:
                        break
                piece = prefix[piece] if piece in prefix else self.shorter(piece)
            if piece is not None:
                out.append(piece)
                at += len(piece)
                last = piece
                piece = longest[at] if at < size else None
            else:  # nothing leads on from here after ``last``
                failed[at] = 1
                piece = out.pop()
                at -= len(piece)
                last = out[-1] if out else ""
        return out

    def _body(self, text: str) -> list[int]:
        out: list[int] = []
        at, ids = 0, self.ids
        for unknown in self.unknown.finditer(text):
            if unknown.start() > at:
                out += [ids[p] for p in self._known(text[at:unknown.start()])]
            out += [self.byte_id[b] for b in unknown[0].encode()]
            at = unknown.end()
        if at < len(text):
            out += [ids[p] for p in self._known(text[at:])]
        return out

    def _merge_run(self, length: int) -> tuple[int, ...]:
        stack: list[int] = []
        for _ in range(length):
            size = 1
            while stack and stack[-1] + size in self.runs:
                size += stack.pop()
            stack.append(size)
        return tuple(self.runs[n] if n > 1 else self.ids[SPACE] for n in stack)

    def chunk(self, chunk: str) -> list[int]:
        """Ids of one chunk: a run of spaces, then no more."""
        rest = chunk.lstrip(SPACE)
        spaces = len(chunk) - len(rest)
        if not rest:
            return list(self._runs(spaces))
        body = self._body(chunk[max(0, spaces - 1):])
        if spaces < 2:
            return body
        free = body[0] == self.ids[SPACE]
        return [*self._runs(spaces if free else spaces - 1), *body[free:]]

    def encode(self, text: str) -> list[int]:
        return [i for c in _CHUNK.findall(self.normalized(text)) for i in self.chunk(c)]

    def decode(self, ids: list[int], start: bool = True) -> str:
        """The text; at the ``start`` of a text the space put before it is dropped. Control ids have no text."""
        out: list[str] = []
        raw = bytearray()

        def flush() -> None:
            at = 0
            while at < len(raw):  # a byte that starts no character stands for itself as U+FFFD
                for size in (1, 2, 3, 4):
                    try:
                        out.append(raw[at:at + size].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    size = 1
                at += size
            raw.clear()

        for i in ids:
            if i in self.bytes:
                raw.append(self.bytes[i])
            elif self.pieces[i] is not None:
                flush()
                out.append(self.pieces[i].replace(SPACE, " "))
        flush()
        text = "".join(out)
        return text[1:] if start and text.startswith(" ") and ids[0] not in self.bytes else text


@lru_cache(2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


class _Memo(dict):
    """Chunk -> (number of ids, ids as text, decoded text); what was not met lately is forgotten."""

    def __init__(self, model: PieceCodec):
        super().__init__()
        self.model = model
        self.older: dict[str, tuple[int, str, str]] = {}

    def __missing__(self, chunk: str) -> tuple[int, str, str]:
        known = self.older.get(chunk)
        if known is None:
            model = self.model
            if chunk[1:2] != SPACE and not model.unknown.search(chunk):  # one space and known characters: pieces only
                pieces = model._known(chunk)
                written = model.written
                known = len(pieces), ",".join([written[p] for p in pieces]), "".join(pieces).replace(SPACE, " ")
            else:
                ids = model.chunk(chunk)
                known = len(ids), ",".join(map(str, ids)), model.decode(ids, start=False)
        if len(chunk) <= MEMO_CHARS:
            if len(self) >= MEMO_CHUNKS:
                self.older = dict(self)
                self.clear()
            self[chunk] = known
        return known


@lru_cache(2)
def _memo(path: str) -> _Memo:
    return _Memo(codec(path))


def encode_column(text: str | Column, path: str) -> Column:
    """The ids of a text as an array of ints; none for an empty or null one."""
    return text_udf("ids array<int>", lambda: lambda value: (codec(path).encode(value),))(text)["ids"]


def decode_column(ids: str | Column, path: str) -> Column:
    """The text of an array of ids; null for a null array."""

    @F.pandas_udf("string")
    def run(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in rows:
            yield pd.Series([None if r is None else codec(path).decode([int(i) for i in r]) for r in batch], dtype=object)

    return run(ids)


def _digest(path: str):
    def make():
        memo = _memo(path)

        def work(text: str) -> tuple[int, str, str]:
            found = [memo[c] for c in _CHUNK.findall(PieceCodec.normalized(text))]
            joined = ",".join([f[1] for f in found])
            decoded = "".join([f[2] for f in found])[1:]  # the first chunk starts with the space put before the text
            return (sum([f[0] for f in found]), hashlib.sha256(joined.encode()).hexdigest(),
                    hashlib.sha256(decoded.encode()).hexdigest())

        return work

    return make


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``docs(doc_id, text)``, one row each.

    A null text is encoded like an empty one: no ids. Repeated rows keep a row each.
    """
    small_batches(docs.sparkSession)
    found = text_udf("n_tokens long, ids_sha256 string, decoded_sha256 string", _digest(path))("text")
    return docs.select("doc_id", found.alias("r")).select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")
