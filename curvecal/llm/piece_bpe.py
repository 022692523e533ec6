"""SentencePiece encoding and decoding for merge-type (BPE) models.

Encoding backtracks instead of replaying merges: Aho-Corasick finds every piece that ends
at each position, the longest piece is tried first at each start, and a piece is accepted
only if re-merging the text of it and its left neighbour gives exactly those two pieces.
A sequence whose neighbours are all compatible is the one that merging produces. Positions
from which no continuation was found are kept in a bit field and never tried again, so the
work stays linear.

A model in which the space mark stands only at the start of a piece never merges across
"other character, space mark", so a text is cut there and each distinct stretch is encoded
once while it stays in a bounded cache; a line end, which is no piece, cuts too. Inside short stretches the automaton's trie is asked
for the longest match only where a piece begins; long ones get one pass of the automaton.

Null and empty texts give no ids and decode to the empty text. Rows are independent:
repeated rows give repeated results and other columns pass through.
"""

import re
from array import array
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6  # fixed values of the model format
CACHE = 150_000
LONG = 48


class PieceModel:
    """One loaded model file: exact encoding and decoding of one text."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if (model.trainer_spec.model_type != proto.TrainerSpec.BPE or not model.trainer_spec.byte_fallback
                or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix
                or not spec.escape_whitespaces or any(p.type == USER or "\n" in p.piece for p in model.pieces)):
            raise ValueError("needs a merge-type model with byte fallback, identity normalisation and no own symbols")
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece holds a space mark behind other characters")
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.high = {i: b for b, i in self.byte.items() if b > 127}  # need their neighbours to become text
        self.text = [{NORMAL: p.piece.replace(SPACE, " "), UNKNOWN: model.trainer_spec.unk_surface}.get(p.type, "")
                     for p in model.pieces]
        for b in range(128):
            self.text[self.byte[b]] = chr(b)
        self.spaced = {i for p, i in self.id.items() if p[0] == SPACE}
        self.finder = ahocorasick.Automaton()
        for piece in self.id:
            self.finder.add_word(piece, piece)
        self.finder.make_automaton()
        # the next shorter piece with which the same position can go on
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.id), None) for p in self.id}
        self.chars = {p for p in self.id if len(p) == 1}
        # every path of the automaton's trie -> the longest piece that begins it
        self.best: dict[str, str | None] = {}
        for piece in self.id:
            for n in range(len(piece), 0, -1):
                if piece[:n] in self.best:
                    break
                self.best[piece[:n]] = piece[:n] if piece[:n] in self.id else self._begin(piece[:n])
        self.fits = Recent()
        self.cache = Recent()

    def _begin(self, path: str) -> str | None:
        return next((path[:n] for n in range(len(path) - 1, 0, -1) if path[:n] in self.id), None)

    def merge(self, text: str) -> list[str]:
        """Highest score first, leftmost among equals; for the short texts of two pieces."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            known = self.merge(left + right) == [left, right]
            self.fits.put((left, right), known)
        return known

    def split(self, text: str) -> list[str]:
        """Pieces of a stretch in which every character is itself a piece."""
        if len(text) > LONG:  # one pass over the text finds the matches of all positions
            longest: list[str | None] = [None] * len(text)
            for end, piece in self.finder.iter(text):
                start = end - len(piece) + 1
                if longest[start] is None or len(longest[start]) < len(piece):
                    longest[start] = piece
            match = longest.__getitem__
        else:
            prefix, best = self.finder.longest_prefix, self.best

            def match(i):
                rest = text[i:]
                return best[rest[:prefix(rest)]]
        failed = bytearray(len(text) // 8 + 1)
        out: list[str] = []
        at, end, left = 0, len(text), None
        known, shorter = self.fits.new.get, self.shorter
        piece = match(0) if text else None
        while at < end:
            while piece is not None:
                after = at + len(piece)
                if not failed[after >> 3] >> (after & 7) & 1:
                    fit = left is None or known((left, piece))
                    if fit is None:
                        fit = self.compatible(left, piece)
                        known = self.fits.new.get
                    if fit:
                        break
                piece = shorter[piece]
            if piece is not None:
                out.append(piece)
                at, left = after, piece
                if at < end:
                    piece = match(at)
                continue
            failed[at >> 3] |= 1 << (at & 7)
            last = out.pop()  # a way always exists: the merges' own result
            left = out[-1] if out else None
            at -= len(last)
            piece = shorter[last]
        return out

    def stretch(self, text: str) -> tuple[int, ...]:
        """Ids of a stretch; unknown characters never merge and become bytes."""
        if self.chars.issuperset(text):
            return tuple(map(self.id.__getitem__, self.split(text)))
        out: list[int] = []
        known: list[str] = []
        for c in text:
            if c in self.chars:
                known.append(c)
                continue
            out += map(self.id.__getitem__, self.split("".join(known)))
            known.clear()
            out += map(self.byte.__getitem__, c.encode("utf-8", "surrogatepass"))
        out += map(self.id.__getitem__, self.split("".join(known)))
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        stretches = STRETCH.findall(SPACE + text.replace(" ", SPACE))
        rows = list(map(self.cache.new.get, stretches))
        if None in rows:
            for i, row in enumerate(rows):
                if row is None:
                    s = stretches[i]
                    rows[i] = row = self.cache.get(s) or self.stretch(s)
                    if len(s) <= LONG:
                        self.cache.put(s, row)
        return list(chain.from_iterable(rows))

    def decode(self, ids: list[int]) -> str:
        """Text of any ids; bytes that are no UTF-8 become one replacement mark each."""
        if self.high.keys().isdisjoint(ids):
            out = "".join(map(self.text.__getitem__, ids))
        else:
            parts, raw = [], bytearray()
            for i in ids:
                b = self.high.get(i)
                if b is not None:
                    raw.append(b)
                    continue
                if raw:
                    parts.append(_utf8(bytes(raw)))
                    raw.clear()
                parts.append(self.text[i])
            if raw:
                parts.append(_utf8(bytes(raw)))
            out = "".join(parts)
        # the space put before every text goes again, also behind control ids, which have no text
        first = next((i for i in ids if self.text[i] or i in self.high), None)
        return out[1:] if first in self.spaced else out


class Recent:
    """A dictionary of bounded size: what was not asked for while it filled up again is dropped."""

    def __init__(self, size: int = CACHE):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


STRETCH = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+")
_loaded: dict[str, PieceModel] = {}


def _utf8(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at:at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def load(path: str) -> PieceModel:
    """The model of this worker process; the path is read where the work is done."""
    if path not in _loaded:
        _loaded[path] = PieceModel(path)
    return _loaded[path]


def _extended(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema if f.name != name] + [T.StructField(name, kind)])


def encode(df: DataFrame, model: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the ids of every whole text; a column already called ``out`` is replaced."""
    def run(batches):
        coder = load(model)
        for b in batches:
            ids, offsets = array("i"), [0]
            for value in b.column(text):
                ids.extend(coder.encode(value.as_py()))
                offsets.append(len(ids))
            values = pa.array(np.frombuffer(ids, np.int32))
            yield _with(b, out, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values))

    return df.mapInArrow(run, _extended(df, out, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of every row's ids."""
    def run(batches):
        coder = load(model)
        for b in batches:
            column = b.column(ids)
            size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            end = size.cumsum()
            texts = [coder.decode(flat[e - n:e].tolist()) for e, n in zip(end.tolist(), size.tolist())]
            yield _with(b, out, pa.array(texts, pa.string()))

    return df.mapInArrow(run, _extended(df, out, T.StringType()))


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), values], names=[*kept, name])
