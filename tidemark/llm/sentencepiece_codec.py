"""SentencePiece encoding and decoding that keeps the original byte span of every piece.

The text is normalised here as the model says: at each place the longest prefix in the model's compiled character map is
replaced, spaces are escaped, a dummy prefix may be added and extra spaces removed.  For every normalised byte the
original byte from which it comes is kept, so that a piece's extent in the normalised text projects to a span of the
original.  The normalised text is segmented here too: its characters are merged pair by pair, the best-scored piece
first and the leftmost of equals, and what is no piece falls back to its bytes, or to the unknown id, of which adjacent
ones are one.  Stretches that no piece goes over the ends of are segmented alone, and short ones are remembered.  Ids equal those of the sentencepiece library, which decodes them.

Defined cases: a null text counts as empty; an empty text has only the begin and end ids, whose spans are empty; an
unknown piece covers the characters that it stands for; rows are independent, so copies give equal results; columns
other than id and text are not read, whatever their names; an empty table gives an empty result.  Models other than
merging ones, and pieces that a user has defined, raise an error.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import narrowed, released, slices, spread

SPACE = "▁".encode()
#: Stretches of up to so many characters are remembered, so many new ones until those that haven't come again are forgotten.
SHORT, REMEMBERED = 32, 1 << 18
#: Stretches of up to so many characters are merged at once, longer ones are first cut where no piece goes over.
WORD = 16
#: Marks that end a word, and the letters before them.
MARKS, LETTER = ".,;:!?)\"'\u2026\u2019\u201d", re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]")
_NONE = float("-inf")


@dataclass
class CharMap:
    """The compiled character map: a double-array trie over UTF-8 bytes whose values are places in a block of strings."""

    units: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint32))
    strings: bytes = b""

    @classmethod
    def parse(cls, blob: bytes) -> CharMap:
        if not blob:
            return cls()
        size = int.from_bytes(blob[:4], "little")
        return cls(np.frombuffer(blob, "<u4", size // 4, 4), blob[4 + size :])

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(length, replacement) of the longest entry that ``data`` has at ``at``."""
        if not len(self.units):
            return None
        found, node = None, self._offset(int(self.units[0]))
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = int(self.units[node])
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, int(self.units[node]) & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])]


@dataclass
class Codec:
    """A model with its normaliser. ``proto``: the bytes of the model's file."""

    proto: bytes

    def __post_init__(self) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(self.proto)
        spec = model.normalizer_spec
        self.dummy, self.trim, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = model.trainer_spec.treat_whitespace_as_suffix
        self.map = CharMap.parse(spec.precompiled_charsmap)
        kinds = model.SentencePiece
        if model.trainer_spec.model_type != model.trainer_spec.BPE or any(p.type == kinds.USER_DEFINED for p in model.pieces):
            raise ValueError("the model must be a merging one (BPE) without pieces that a user has defined")
        self.pieces = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.UNUSED)}
        self.unused = {p.piece for p in model.pieces if p.type == kinds.UNUSED}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE} if model.trainer_spec.byte_fallback else {}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        space = SPACE.decode() if self.escape else " "
        alone = not any(re.search(f"[^{space}]{space}", p) for p in self.pieces)
        self.adjacent = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        # A word and a mark right behind it are two stretches if no piece has a letter before the mark, and so are lines.
        bound, line = {p[1] for p in self.adjacent if LETTER.match(p[0])}, "" if any("\n" in p for p in self.adjacent) else "\n"
        marks = re.escape("".join(m for m in MARKS if m not in bound))
        words = f"{space}*+[^{space}{line}{marks}]++(?:(?<={LETTER.pattern})(?=[{marks}])|[^{space}{line}]*+)|" if marks else ""
        lines = f"{line}++|" if line else ""
        self.stretches = re.compile(f"{words}{space}*+[^{space}{line}]++|{lines}{space}++" if alone else "(?s).+")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=self.proto)
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.scores = {piece: score for piece, (_, score) in self.pieces.items()}
        self.units = {piece: array("I", [i, len(piece.encode())]).tobytes() for piece, (i, _) in self.pieces.items() if piece not in self.unused}
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised text and for each of its bytes, and its end, the byte of the original from which it comes."""
        data = text.encode()
        if not data:
            return b"", np.zeros(1, np.int64)
        space = SPACE if self.escape else b" "
        if not len(self.map.units) and not self.trim:
            codes = np.frombuffer(data, np.uint8)
            each = np.where(codes == 0x20, len(space), 1)
            out, source = data.replace(b" ", space), np.repeat(np.arange(len(data)), each)
        else:
            out, source = self._by_map(data, space)
        if self.dummy and out:
            out, source = (out + space, np.append(source, np.full(len(space), len(data)))) if self.suffix else (space + out, np.insert(source, 0, np.full(len(space), source[0])))
        return out, np.append(source, len(data))

    def _by_map(self, data: bytes, space: bytes) -> tuple[bytes, np.ndarray]:
        out, source, at, blank = bytearray(), [], 0, self.trim
        while at < len(data):
            hit = self.map.longest(data, at)
            if hit is None:
                head = data[at]
                n = 1 if head < 0x80 else 2 if head < 0xE0 else 3 if head < 0xF0 else 4
                hit = n, data[at : at + n]
            n, new = hit
            for i in range(len(new)):
                if new[i] == 0x20:
                    if not (self.trim and blank):
                        out += space
                        source += [at] * len(space)
                    blank = True
                else:
                    out.append(new[i])
                    source.append(at)
                    blank = False
            at += n
        if self.trim:
            while out.endswith(space):
                del out[-len(space) :], source[-len(space) :]
        return bytes(out), np.array(source, np.int64)

    def merged_short(self, text: str) -> list[str]:
        """A short stretch in pieces, for a model without unused ones: the best of all pairs is looked for at each step."""
        parts, score = list(text), self.scores.get
        scores = list(map(score, map(add, text, text[1:]), repeat(_NONE)))
        while scores and (best := max(scores)) != _NONE:
            i = scores.index(best)  # the leftmost of equals
            parts[i] += parts.pop(i + 1)
            del scores[i]
            if i < len(scores):
                scores[i] = score(parts[i] + parts[i + 1], _NONE)
            if i:
                scores[i - 1] = score(parts[i - 1] + parts[i], _NONE)
        return parts

    def merged(self, text: str) -> list[str]:
        """A stretch of normalised text in pieces, with a queue of pairs."""
        parts: list[str] = list(text)
        n, pieces, made = len(parts), self.pieces, {}
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(-hit[1], i, i + 1, pair) for i in range(n - 1) if (hit := pieces.get(pair := parts[i] + parts[i + 1]))]
        for _, i, j, pair in agenda:
            if pair in self.unused:
                made[pair] = parts[i], parts[j]
        heapify(agenda)
        while agenda:
            _, i, j, pair = heappop(agenda)
            if right[i] != j or not parts[i] or parts[i] + parts[j] != pair:
                continue
            parts[i], parts[j], after = pair, "", right[j]
            right[i] = after
            if after >= 0:
                left[after] = i
            for x, y in ((left[i], i), (i, after)):
                if x >= 0 and y >= 0 and (hit := pieces.get(new := parts[x] + parts[y])):
                    heappush(agenda, (-hit[1], x, y, new))
                    if new in self.unused:
                        made[new] = parts[x], parts[y]
        out, todo = [], [p for p in reversed(parts) if p]
        while todo:  # unused pieces come apart again
            piece = todo.pop()
            if piece in made:
                todo += reversed(made[piece])
            else:
                out.append(piece)
        return out

    def unpieced(self, text: str) -> bytes:
        """The ids of what is no piece, as ``segment`` gives them: those of its bytes, or the unknown one."""
        data = text.encode()
        found = [x for b in data for x in (self.bytes[b], 1)] if self.bytes else [self.unknown, len(data)]
        return array("I", found).tobytes()

    def segment(self, text: str) -> bytes:
        """The ids of a stretch, each with how many bytes of it the id covers, as pairs of 32-bit numbers."""
        short = len(text) <= SHORT
        known = self._older.get(text) if short else None
        if known is None:
            # No piece goes over a pair of characters that no piece has, so what lies between such pairs is segmented alone.
            cuts = [] if len(text) <= WORD else [i for i, pair in enumerate(map(add, text, text[1:]), 1) if pair not in self.adjacent]
            if cuts:
                parts = [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)])]
                known = b"".join([self._known.get(part) or self.segment(part) for part in parts])
        if known is None:
            units = self.units.get
            known = b"".join([units(piece) or self.unpieced(piece) for piece in (self.merged_short(text) if short and not self.unused else self.merged(text))])
        if short:
            self._known[text] = known
        return known

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids with begin and end, and the first and last byte (exclusive) of each in the original text."""
        norm, source = self.normalise(text or "")
        stretches, known = self.stretches.findall(norm.decode()), self._known
        new = set(stretches).difference(known)
        for stretch in new:
            known[stretch] = self.segment(stretch)
        found = b"".join(map(known.__getitem__, stretches))
        for stretch in new:
            if len(stretch) > SHORT:
                del known[stretch]
        if len(known) >= REMEMBERED:
            self._known, self._older = {}, known
        first, last = array("I", [self.begin, 0]).tobytes(), array("I", [self.end, 0]).tobytes()
        numbers, width = np.frombuffer(first + found + last, np.uint32).reshape(-1, 2).T.astype(np.int64)
        if not self.bytes:
            keep = np.r_[True, (numbers[1:] != self.unknown) | (numbers[:-1] != self.unknown)]
            numbers, width = numbers[keep], np.add.reduceat(width, np.flatnonzero(keep))
        upto = np.cumsum(width)
        return numbers, source[upto - width], source[upto]

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


def encoded(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, begins, ends and the decoded text of every row; spans are bytes of the original text in UTF-8."""
    with open(model_path, "rb") as f:
        proto = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(proto)
        for batch in slices(batches):
            rows = [codec.encode(t.as_py()) for t in batch.column(1)]
            lists = [pa.array([r[i].astype(np.int32) for r in rows], pa.list_(pa.int32())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.array([codec.decode(r[0]) for r in rows], pa.string())], ["doc_id", "ids", "begins", "ends", "decoded"])

    rows = narrowed(df, doc_id=(id_col, "long"), text=(text_col, "string"))
    return spread(rows).mapInArrow(released(run), "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string")


def digests(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``encoded`` gives, reduced in the same pass to doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256."""
    with open(model_path, "rb") as f:
        proto = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sha = Codec(proto), lambda b: hashlib.sha256(b).hexdigest()
        for batch in slices(batches):
            out = []
            for text in batch.column(1):
                ids, begins, ends = codec.encode(text.as_py())
                out.append((len(ids), sha(ids.astype("<u4").tobytes()), sha(codec.decode(ids).encode()), sha(np.stack([begins, ends], 1).astype("<u8").tobytes())))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), *[pa.array(c, pa.string()) for c in columns[1:]]], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    rows = narrowed(df, doc_id=(id_col, "long"), text=(text_col, "string"))
    return spread(rows).mapInArrow(released(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
