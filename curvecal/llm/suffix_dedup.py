"""Removal of byte strings that an earlier document already has, by a distributed suffix sort.

Every ``LENGTH``-byte window is a suffix cut to its length. Equal windows must be brought
together without sending each of the many overlapping windows:

1. A window belongs to the place inside it whose ``GRAM`` bytes hash lowest (leftmost of
   equals). That choice depends on the window's bytes only, so equal windows agree on it.
   Neighbouring windows with one such anchor form a record. Records carry two 64-bit hashes,
   of the anchor and of all bytes of their windows, and are dealt out by the anchor.
2. Of records with equal hashes only the smallest document's stays open, the others' windows
   are repeats. This is done inside each task first, so that a text with any number of
   copies sends one record a task. Anchors with a single context are finished.
3. Anchors seen in different contexts send the text of their records, and their windows are
   suffix-sorted: suffixes are ordered by stable merge sort on the eight bytes behind the
   extension they share with the head of their run; that extension is found by binary search
   on prefix hashes, in log2(LENGTH) steps. Suffixes that reach LENGTH are compared byte by
   byte before they count as equal. Of equal ones all but the smallest document's are repeats.
4. A document loses the bytes under its repeated windows.

Anchors that a bounded sample of documents (``HOT_SAMPLE``) shows in over one percent of them
are dealt out window by window instead, by two independent 64-bit hashes of the window, so
that a passage in a third of all documents is no hot key; this only decides the way, the
result is the same.

Null and empty texts keep zero bytes. Rows with a null id are returned whole and are no
source. A repeated id must repeat its text; windows repeated inside one document stay. Texts
under LENGTH bytes are returned whole.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvecal.llm.common import shuffle_files_freed, total_bytes
from curvecal.llm.rolling import inverse_powers, mix, prefix_hashes, stretch_hashes
from curvecal.session import materialize

LENGTH, GRAM = 50, 20
BLOCK_BYTES = 1 << 20
FLUSH = 400_000
PART_BYTES = 8 << 20  # text bytes of a group; its records and their sorted copies stand in memory together
HOT_SAMPLE, HOT_SHARE = 4_000, 0.01
LOW = np.uint64(0xFFFFFFFF)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, x
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def records(texts: list[bytes], length: int, gram: int):
    """(text number, first window, windows, anchor hash, context hash) of all records, and the hash of single windows."""
    size = np.array([len(t) for t in texts])
    begin = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), lambda p: p.astype(np.uint64)
    prefix = prefix_hashes(data)
    inverse = inverse_powers(n + 1)
    h = mix((prefix[gram:] - prefix[:-gram]) * inverse[: n - gram + 1])
    key = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
    anchor = (sliding_min(key, length - gram + 1) & LOW).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), size)
    good = owner[: n - length + 1] == owner[length - 1:]
    first = good.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~good[:-1] | (owner[1: len(good)] != owner[: len(good) - 1])
    lo = np.flatnonzero(first)
    last = good.copy()
    last[:-1] &= first[1:] | ~good[1:]
    hi = np.flatnonzero(last)
    who = owner[lo]
    return (who, lo - begin[who], hi - lo + 1, h[anchor[lo]], stretch_hashes(prefix, lo, hi + length),
            lambda p: (stretch_hashes(prefix, begin[p[0]] + p[1], begin[p[0]] + p[1] + length), byte_hashes(data, begin[p[0]] + p[1], length)))


def byte_hashes(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Hashes of stretches chained over eight bytes at a time, independent of the polynomial ones."""
    out = np.full(len(start), length, np.uint64)
    for k in range(0, length, 8):
        word = np.zeros((len(start), 8), np.uint8)
        width = min(8, length - k)
        word[:, :width] = data[start[:, None] + np.arange(k, k + width)]
        out = mix(out * np.uint64(0x9FB21C651E98DF25) ^ mix(word.view(np.uint64)[:, 0] + np.uint64(k + 1)))
    return out


def _blocks(ids, texts):
    part, size = [], 0
    for i, t in zip(ids, texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        part.append((i, raw))
        size += len(raw)
        if size >= BLOCK_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


class Records:
    """Columns of records: document, first window, number of windows or mask, anchor, context."""

    NAMES = ("doc", "lo", "mask", "anchor", "context")
    TYPES = (np.int64, np.uint32, np.uint32, np.uint64, np.uint64)

    def __init__(self, *columns):
        self.columns = [np.ascontiguousarray(c, t) for c, t in zip(columns, self.TYPES)]
        self.doc, self.lo, self.mask, self.anchor, self.context = self.columns

    def take(self, at):
        return Records(*(c[at] for c in self.columns))

    @classmethod
    def join(cls, parts):
        return cls(*(np.concatenate([p.columns[k] for p in parts]) if parts else np.zeros(0, t) for k, t in enumerate(cls.TYPES)))

    def pack(self, hashes: bool = True) -> bytes:
        """Byte planes, so that the many zero bytes of small numbers compress."""
        return b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in self.columns[: 5 if hashes else 3])

    @classmethod
    def unpack(cls, raw: bytes, hashes: bool = True):
        types = cls.TYPES[: 5 if hashes else 3]
        n = len(raw) // sum(np.dtype(t).itemsize for t in types)
        out, at = [], 0
        for t in types:
            w = np.dtype(t).itemsize
            out.append(np.frombuffer(raw, np.uint8, n * w, at).reshape(w, n).T.copy().view(t).reshape(n))
            at += n * w
        out += [np.zeros(n, np.uint64)] * (5 - len(out))
        return cls(*out)


def _full(n):
    return ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)


def split_copies(r: Records) -> tuple[Records, Records]:
    """Records whose hashes a smaller document has too, and the rest, sorted by anchor and context."""
    order = np.lexsort((r.lo, r.doc, r.context, r.anchor))
    doc, new = r.doc[order], np.ones(len(order), bool)
    for k, column in enumerate((r.anchor, r.context)):
        own = column[order]
        differs = own[1:] != own[:-1]
        new[1:] = differs if k == 0 else new[1:] | differs
    least = doc[new][np.cumsum(new) - 1] if len(order) else doc
    again = doc > least
    return r.take(order[again]), r.take(order[~again])


def _dealt(r: Records, keys: np.ndarray, hashes: bool, **constant):
    """Packed rows, one for each key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cuts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else []
    for a, b in zip(cuts, [*cuts[1:], len(keys)]):
        yield int(keys[a]), r.take(order[a:b]).pack(hashes)


def _rows(pairs, kind: str):
    pairs = list(pairs)
    return pa.RecordBatch.from_pydict({
        "kind": pa.array([kind] * len(pairs), pa.string()), "place": pa.array([p[0] for p in pairs], pa.int64()),
        "data": pa.array([p[1] for p in pairs], pa.binary())})


PACKED = "kind string, place bigint, data binary"


def suffix_classes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Class number of each suffix (cut to ``length``): equal exactly where the bytes are equal.

    Runs of suffixes that agree so far have a head. Each round finds every suffix's common
    extension with its head by binary search over prefix hashes, settles those that reach
    the length, and merge-sorts the others by side, extension and the eight bytes behind it.
    """
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    prefix = prefix_hashes(padded)
    inverse = inverse_powers(len(prefix))
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)

    def word(at):
        return np.ascontiguousarray(eight[at]).view(">u8").reshape(-1).astype(np.uint64)

    order = np.argsort(word(starts), kind="stable")
    key = word(starts[order])
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    classes = np.full(len(starts), -1, np.int64)
    used = 0
    left = np.zeros(len(order), np.int64) + 8  # bytes known to agree inside a run
    while len(order):
        run = np.cumsum(new) - 1
        heads = order[new]
        head = starts[heads[run]]
        own = starts[order]
        low, high = np.minimum(left, length), np.full(len(order), length, np.int64)
        while (open_ := low < high).any():  # longest extension whose hashes agree
            middle = (low + high + 1) // 2
            same = (prefix[own + middle] - prefix[own]) * inverse[own] == (prefix[head + middle] - prefix[head]) * inverse[head]
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)
        settled = low >= length
        if settled.any():  # collisions: hashes agreed, so the bytes must
            for a in range(0, len(order), 1 << 16):
                at = np.arange(a, min(a + (1 << 16), len(order)))
                at = at[settled[at]]
                for k in range(0, length, 8):
                    shift = min(k, length - 8)
                    wrong = word(own[at] + shift) != word(head[at] + shift)
                    if wrong.any():
                        raise ValueError("two different strings share a hash; choose another base")
        classes[order[settled]] = used + run[settled]
        used += int(run[-1]) + 1
        keep = ~settled
        order, run, low, own, head = order[keep], run[keep], low[keep], own[keep], head[keep]
        if not len(order):
            break
        after = padded[own + low] > padded[head + low]
        depth = np.where(after, -low, low)
        beyond = (np.maximum(low + 8 - length, 0) * 8).astype(np.uint64)  # bits behind the cut do not count
        behind = word(own + low) >> beyond << beyond
        again = np.lexsort((behind, depth, after, run))
        order, run, depth, behind, after, low = (x[again] for x in (order, run, depth, behind, after, low))
        new = np.ones(len(order), bool)
        new[1:] = (run[1:] != run[:-1]) | (after[1:] != after[:-1]) | (depth[1:] != depth[:-1]) | (behind[1:] != behind[:-1])
        left = low + 8
    return classes


def _sort_windows(r: Records, texts: list[bytes], length: int) -> Records:
    """Windows of the records that a smaller document has, as masks."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])])[:-1]
    n = np.array([len(t) - length + 1 for t in texts])
    record = np.repeat(np.arange(len(texts)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    classes = suffix_classes(data, begin[record] + inside, length)
    least = np.full(classes.max(initial=0) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, classes, r.doc[record])
    again = r.doc[record] > least[classes]
    mask = np.zeros(len(texts), np.uint64)
    np.bitwise_or.at(mask, record[again], np.uint64(1) << inside[again].astype(np.uint64))
    out = Records(r.doc, r.lo, mask.astype(np.uint32), r.anchor, r.context)
    return out.take(mask > 0)


def hot_anchors(docs: DataFrame, length: int, gram: int) -> np.ndarray:
    """Anchors in over HOT_SHARE of a bounded sample: at most 1 / HOT_SHARE times a document's anchors."""
    def run(batches):
        for b in batches:
            for part in _blocks(b.column("id").to_pylist(), b.column("text").to_pylist()):
                who, _, _, anchor, _, _ = records([t for _, t in part], length, gram)
                pairs = np.unique(np.stack([who.astype(np.uint64), anchor]), axis=1)
                yield pa.RecordBatch.from_pydict({"anchor": pa.array(pairs[1].view(np.int64))})

    cells = 1 << 20
    share = int(cells * HOT_SAMPLE / max(1, docs.count())) + 1
    sample = docs.where(F.pmod(F.xxhash64("id"), F.lit(cells)) < share)
    n = sample.count()
    found = (sample.mapInArrow(run, "anchor bigint").groupBy("anchor").count()
             .where(F.col("count") > max(20, HOT_SHARE * n)).select("anchor").collect())
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


def repeated_windows(docs: DataFrame, parts: int, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Packed masks of repeated windows (place: the document's part). docs: id, text, part."""
    spark = docs.sparkSession
    if not gram < length <= gram + 31:
        raise ValueError("a record's windows must fit a 32-bit mask")
    hot = spark.sparkContext.broadcast(hot_anchors(docs, length, gram))

    def first(batches):
        def flush():
            copies, rest = split_copies(Records.join(waiting))
            waiting.clear()
            yield _rows(_dealt(copies, copies.doc % parts, False), "repeat")
            yield _rows(_dealt(rest, (rest.anchor % np.uint64(parts)).astype(np.int64), True), "open")

        waiting, size = [], 0
        for b in batches:
            for part in _blocks(b.column("id").to_pylist(), b.column("text").to_pylist()):
                ids = np.array([i for i, _ in part], np.int64)
                who, lo, n, anchor, context, single = records([t for _, t in part], length, gram)
                at = np.minimum(np.searchsorted(hot.value, anchor), max(0, len(hot.value) - 1))
                is_hot = hot.value[at] == anchor if len(hot.value) else np.zeros(len(anchor), bool)
                waiting.append(Records(ids[who], lo, _full(n), anchor, context).take(~is_hot))
                if is_hot.any():
                    w, m = np.repeat(who[is_hot], n[is_hot]), n[is_hot]
                    p = np.repeat(lo[is_hot], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                    h, second = single((w, p))
                    waiting.append(Records(ids[w], p, np.ones(len(p)), mix(h), second))
                size += sum(len(r.doc) for r in waiting[-2:])
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        if waiting:
            yield from flush()

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        # what tasks have settled passes through, so that their output is dealt out once and not stored before
        known = frame["kind"] == "repeat"
        out = list(frame[known].itertuples(index=False, name=None))
        copies, rest = split_copies(Records.join([Records.unpack(x) for x in frame["data"][~known]]))
        out += [("repeat", k, d) for k, d in _dealt(copies, copies.doc % parts, False)]
        if len(rest.doc):  # anchors with several contexts of several documents stay open
            new = np.ones(len(rest.doc), bool)
            new[1:] = rest.anchor[1:] != rest.anchor[:-1]
            group = np.cumsum(new) - 1
            size = group[-1] + 1
            low, high = np.full(size, np.iinfo(np.int64).max), np.full(size, np.iinfo(np.int64).min)
            np.minimum.at(low, group, rest.doc)
            np.maximum.at(high, group, rest.doc)
            still = rest.take((low < high)[group])
            out += [("text", k, d) for k, d in _dealt(still, still.doc % parts, True)]
        return pd.DataFrame(out, columns=["kind", "place", "data"])

    gathered = materialize(docs.mapInArrow(first, PACKED).groupBy("place").applyInPandas(gather, PACKED), "suffix-open")

    def with_text(_, texts: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(marks) and len(texts):
            raw = {i: t.encode("utf-8", "surrogatepass") for i, t in zip(texts["id"], texts["text"])}
            r = Records.join([Records.unpack(x) for x in marks["data"]])
            bucket = (r.anchor % np.uint64(parts)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            width = np.array([int(m).bit_length() for m in r.mask.tolist()]) + length - 1
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(order)]):
                at = order[a:b]
                piece = b"".join(raw[d][p:p + w] for d, p, w in zip(r.doc[at].tolist(), r.lo[at].tolist(), width[at].tolist()))
                out.append(("sort", int(bucket[at[0]]), len(at).to_bytes(8, "little") + r.take(at).pack() + piece))
        return pd.DataFrame(out, columns=["kind", "place", "data"])

    def sort(frame: pd.DataFrame) -> pd.DataFrame:
        found, pieces = [], []
        each = sum(np.dtype(t).itemsize for t in Records.TYPES)
        for raw in frame["data"]:
            n = int.from_bytes(raw[:8], "little")
            r = Records.unpack(raw[8:8 + n * each])
            found.append(r)
            at = 8 + n * each
            for m in r.mask.tolist():
                w = m.bit_length() + length - 1
                pieces.append(raw[at:at + w])
                at += w
        again = _sort_windows(Records.join(found), pieces, length)
        return pd.DataFrame([("repeat", k, d) for k, d in _dealt(again, again.doc % parts, False)], columns=["kind", "place", "data"])

    wanted = gathered.where("kind = 'text'")
    sorted_ = materialize(
        docs.groupBy("part").cogroup(wanted.groupBy("place")).applyInPandas(with_text, PACKED)
        .groupBy("place").applyInPandas(sort, PACKED), "suffix-sorted")
    return gathered.where("kind = 'repeat'").union(sorted_)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, spans, kept): removed byte spans (start, end exclusive) and the bytes that stay."""
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"),
                         F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    parts = max(8, total_bytes(source) // PART_BYTES) | 1
    known = source.where("id IS NOT NULL").withColumn("part", F.pmod("id", F.lit(parts)).cast("bigint"))
    with shuffle_files_freed(spark):
        marks = repeated_windows(known, parts, length)
    result = "id bigint, n_bytes bigint, spans array<struct<start:int,end:int>>, kept binary"

    def cut(_, texts: pd.DataFrame, packed: pd.DataFrame) -> pd.DataFrame:
        r = Records.join([Records.unpack(x, False) for x in packed["data"]])
        order = np.argsort(r.doc, kind="stable")
        r = r.take(order)
        out = []
        for i, t in zip(texts["id"], texts["text"]):
            raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
            a, b = np.searchsorted(r.doc, [i, i + 1]) if len(r.doc) else (0, 0)
            gone = np.zeros(len(raw) + 1, np.int32)
            if b > a:
                for bit in range(32):
                    at = r.lo[a:b][(r.mask[a:b] >> np.uint32(bit)) & np.uint32(1) > 0].astype(np.int64) + bit
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + length, -1)
            inside = np.cumsum(gone[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
            out.append((i, len(raw), [{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2])],
                        raw[~inside].tobytes()))
        return pd.DataFrame(out, columns=["id", "n_bytes", "spans", "kept"])

    done = known.groupBy("part").cogroup(marks.groupBy("place")).applyInPandas(cut, result)
    rest = source.where("id IS NULL").select(
        "id", F.octet_length("text").cast("bigint").alias("n_bytes"),
        F.expr("CAST(array() AS array<struct<start:int,end:int>>)").alias("spans"), F.encode("text", "UTF-8").alias("kept"))
    return done.unionByName(rest)
