"""Near-duplicate documents by an exact Jaccard join on word shingles.

Documents link if intersection / union of their shingle sets reaches num / den. Sets are
ordered from rare to frequent shingles (ties by hash), with frequencies counted over all
distinct sets. Two similar sets share at least one signature of a long enough prefix:

- a rare shingle is a signature by itself;
- frequent shingles are split into classes (in over FEW sets, over FEW^2), and each class
  into parts; in a part of class k only combinations of k shingles are signatures. The
  prefix is extended by the up to k - 1 common shingles that may stay without a combination
  in each part, so nothing is lost;
- sets too short for such an extension are indexed by single shingles.

Equal sets are one representative throughout. Frequencies travel as one byte a shingle on a
rising scale, packed by hash range, so that hot shingles are counted inside a task and no
row is made per shingle. Each document is first verified against the smallest document of
its buckets; buckets whose members are then connected are done, and only pairs of different
components are verified further. Pairs whose parity bitmaps differ in more bits than the
sets may differ in shingles are out, inside the join that finds them; the others' whole sets
of 64-bit hashes are intersected. A bucket that still holds over FULL sets is split first: if
two bitmaps differ in at most d bits, they agree in one of d + 1 pieces, so a set goes to one
smaller bucket per piece, for its own size and for that of a smaller partner. The most common
component of a bucket is compared with the others only.

Empty and null texts have no set and link with nothing. Rows whose id is null link with
nothing and get no component. Repeated rows are copies; an id that repeats must repeat its
text. Extra columns are not read.
"""

import hashlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvecal.llm.common import shuffle_files_freed, total_bytes
from curvecal.llm.components import components
from curvecal.llm.rolling import mix, shingles
from curvecal.session import materialize

#: Sets that may hold a shingle of the first class; parts of the classes of pairs and triples.
FEW = 256
#: Sets of a bucket that are compared pair by pair; larger buckets are split by pieces of the bitmap.
FULL = 4096
#: Bits of the parity bitmap; text bytes a task works on at once.
BITS = 1024
PART_BYTES = 12 << 20
FLUSH = 1_000_000
PARTS = {2: 12, 3: 10}
#: Sets below this size cannot always spare the extension (at most 12 * 1 + 10 * 2 shingles).
SHORT = 40


def least_overlap(size: int, num: int, den: int) -> int:
    """Common shingles that any partner of a set of this size must have."""
    return -(-num * size // den)


def both_ways(num: int, den: int) -> int:
    """Largest set that can link with a short one."""
    return SHORT * den // num


def code(count: np.ndarray) -> np.ndarray:
    """One byte that rises with the count: exact to 100, then 16 steps a doubling."""
    c = np.maximum(count, 1)
    return np.where(c <= 100, c, np.minimum(255, 100 + np.floor(16 * np.log2(np.maximum(c, 100) / 100)))).astype(np.uint8)


def limits() -> tuple[int, int]:
    """Largest codes of the first and second class."""
    return int(code(np.array([FEW]))[0]), int(code(np.array([FEW * FEW]))[0])


def document_sets(docs: DataFrame, n: int) -> DataFrame:
    """id, size, key of the whole set, parity bitmap."""
    def run(batches):
        for b in batches:
            size, key, bits = [], [], []
            for text in b.column("text").to_pylist():
                s = shingles(text, n)
                size.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                parity = np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
                bits.append(np.packbits(parity.astype(bool)).view(np.int64))
            yield pa.RecordBatch.from_pydict({
                "id": b.column("id"), "size": pa.array(size, pa.int32()), "key": pa.array(key, pa.binary()),
                "bits": pa.array(bits, pa.list_(pa.int64()))})

    return docs.mapInArrow(run, "id bigint, size int, key binary, bits array<bigint>")


def signatures(s: np.ndarray, codes: np.ndarray, num: int, den: int) -> set[int]:
    """Signatures of a set of hashes with their frequency codes."""
    size = len(s)
    order = np.lexsort((s, codes))
    need = size - least_overlap(size, num, den) + 1
    first = int(np.searchsorted(codes[order], 2))  # shingles of this set alone come before and meet nobody
    out = set()
    if size <= both_ways(num, den):
        out.update(_signed(1, int(h)) for h in s[order[first:need]].tolist())
    if size >= SHORT:
        one, two = limits()
        parts: dict[tuple[int, int], list[int]] = defaultdict(list)
        at, spare = first, 0
        while at < size and at - spare < need:  # the shingles before ``at`` do not suffice yet
            h, c = int(s[order[at]]), codes[order[at]]
            at += 1
            k = 1 if c <= one else 2 if c <= two else 3
            if k == 1:
                out.add(_signed(2, h))
                continue
            members = parts[k, h % PARTS[k]]
            members.append(h)
            spare += len(members) < k
        for (k, _), members in parts.items():
            out.update(_signed(k + 1, *c) for c in combinations(members, k))
    return out


def _signed(tag: int, *hashes: int) -> int:
    v = tag
    for h in hashes:
        v = (v * 0x9FB21C651E98DF25 + (h & 0xFFFFFFFFFFFFFFFF)) & 0xFFFFFFFFFFFFFFFF
        v ^= v >> 31
        v = v * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
    v ^= v >> 32
    return v - (1 << 64) if v >> 63 else v


def _signature_rows(representatives: DataFrame, n: int, num: int, den: int, parts: int) -> DataFrame:
    """(signature, id, size) of all sets. representatives: id, text, part."""
    width = max(3, (parts - 1).bit_length())
    shift = np.uint64(64 - width)
    packed = "place bigint, bucket bigint, data binary"

    def deal(batches):
        def flush():
            tokens = np.concatenate([s for _, s in waiting])
            owner = np.repeat(np.arange(len(waiting)), [len(s) for _, s in waiting])
            ids = np.array([i for i, _ in waiting], np.int64)
            bucket = (tokens >> shift).astype(np.int64)
            order = np.argsort(bucket, kind="stable")  # inside a bucket: by document, then by hash
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            # 32 bits behind the bucket's: where two shingles share them, they share a count, which is as good an order
            tokens = ((tokens << np.uint64(width)) >> np.uint64(32)).astype(np.uint32)
            rows = [(int(bucket[order[a]]), _pack(ids, owner[order[a:b]], tokens[order[a:b]]))
                    for a, b in zip(cuts, [*cuts[1:], len(order)])]
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([0] * len(rows), pa.int64()),
                                               pa.array([r[1] for r in rows], pa.binary())], names=["place", "bucket", "data"])

        waiting, size = [], 0
        for b in batches:
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                waiting.append((i, shingles(t, n)))
                size += len(waiting[-1][1])
                if size >= FLUSH:
                    yield flush()
                    size = 0
        if waiting:
            yield flush()

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        rows = [_unpack(d, np.uint32) for d in frame["data"]]
        tokens = np.concatenate([r[2] for r in rows])
        _, where, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        codes, at, out = code(counts)[where], 0, []
        ids = np.concatenate([r[0] for r in rows])
        sizes = np.concatenate([r[1] for r in rows])
        owner = np.repeat(np.arange(len(ids)), sizes)
        part = (ids % parts)[owner]
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            out.append((int(part[order[a]]), int(frame["place"].iloc[0]), _pack(ids, owner[order[a:b]], codes[order[a:b]])))
        return pd.DataFrame(out, columns=["place", "bucket", "data"])

    def sign(_, texts: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        pieces: dict[int, list[np.ndarray]] = defaultdict(list)
        for d in marks.sort_values("bucket")["data"]:  # buckets are hash ranges, so pieces follow the set's order
            ids, sizes, codes = _unpack(d, np.uint8)
            for i, piece in zip(ids.tolist(), np.split(codes, np.cumsum(sizes)[:-1])):
                pieces[i].append(piece)
        out = []
        for i, t in zip(texts["id"], texts["text"]):
            s = shingles(t, n)
            if len(s):
                out.append(pd.DataFrame({"signature": list(signatures(s, np.concatenate(pieces[i]), num, den)), "id": i, "size": len(s)}))
        frame = pd.concat(out) if out else pd.DataFrame({"signature": [], "id": [], "size": []})
        return frame.astype({"signature": "int64", "id": "int64", "size": "int32"})

    counted = (representatives.select("id", "text").mapInArrow(deal, packed).groupBy("place").applyInPandas(count, packed))
    return (representatives.groupBy("part").cogroup(counted.groupBy("place"))
            .applyInPandas(sign, "signature bigint, id bigint, size int"))


def _pack(ids: np.ndarray, owner: np.ndarray, values: np.ndarray) -> bytes:
    """Documents, number of values of each, values; owner is sorted."""
    own, n = np.unique(owner, return_counts=True)
    return len(own).to_bytes(8, "little") + ids[own].tobytes() + n.astype(np.int32).tobytes() + values.tobytes()


def _unpack(raw: bytes, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(raw[:8], "little")
    return (np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int32, n, 8 + 8 * n), np.frombuffer(raw, kind, -1, 8 + 12 * n))


def _may_link(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose bitmaps do not rule a link out: equal parity of a bit hides differences, never adds one."""
    own = sets.select("id", "size", "bits")
    both = (pairs.join(own.select(F.col("id").alias("a"), F.col("size").alias("n"), F.col("bits").alias("x")), "a")
            .join(own.select(F.col("id").alias("b"), F.col("size").alias("m"), F.col("bits").alias("y")), "b"))
    differ = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda p, q: p + q)
    return both.where(differ * (den + num) <= (F.col("n") + F.col("m")) * (den - num)).select("a", "b")


def size_classes(largest: int, num: int, den: int) -> list[int]:
    """Rising first sizes of classes from size 1 to past ``largest``; partners are in one class or in neighbouring ones."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, out[-1] * den // num + 1))
    return [*out, out[-1] * den // num + 1]


def piece_hashes(bits: np.ndarray, pieces: int) -> np.ndarray:
    """One number per row and piece of the bitmaps (rows of 0 and 1): equal pieces have equal numbers."""
    if pieces > BITS:  # a piece may be empty, and empty pieces agree
        return np.zeros((len(bits), 1), np.uint64)
    order = np.argsort(np.arange(BITS) % pieces, kind="stable")
    starts = np.searchsorted((np.arange(BITS) % pieces)[order], np.arange(pieces))
    weight = np.random.default_rng(1).integers(0, 1 << 64, BITS, np.uint64)[order]
    return np.add.reduceat(np.where(bits[:, order] > 0, weight, np.uint64(0)), starts, axis=1)


def split_buckets(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (signature, id, size, label, bits) dealt to one bucket per bitmap piece: (signature, id, size, label, larger).

    Two rows of a bucket that link meet in a bucket of the smaller one's size class; ``larger`` marks the other's.
    """
    def run(batches):
        for b in batches:
            size = b.column("size").to_numpy()
            if not len(size):
                continue
            first = size_classes(int(size.max()), num, den)
            own = np.searchsorted(first, size, side="right") - 1
            bits = np.unpackbits(b.column("bits").flatten().to_numpy().view(np.uint8).reshape(-1, BITS // 8), axis=1)
            signature = b.column("signature").to_numpy().view(np.uint64)
            for larger in (False, True):
                for c in np.unique(own[own >= larger]) - larger:
                    at = np.flatnonzero(own == c + larger)
                    top = first[c + 1] - 1
                    pieces = (top + top * den // num) * (den - num) // (den + num) + 1
                    h = piece_hashes(bits[at], pieces)
                    place = np.arange(h.shape[1], dtype=np.uint64) + (np.uint64(c) << np.uint64(32))
                    key = mix(mix(signature[at][:, None] + mix(place + np.uint64(1))) ^ h)
                    again = pa.array(np.repeat(at, h.shape[1]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.ravel().view(np.int64)), *(b.column(x).take(again) for x in ("id", "size", "label")),
                         pa.array(np.full(key.size, larger))], names=["signature", "id", "size", "label", "larger"])

    return rows.select("signature", "id", "size", "label", "bits").mapInArrow(
        run, "signature bigint, id bigint, size int, label bigint, larger boolean")


def _open_pairs(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of different labels in a bucket that sizes and bitmaps allow to link. rows: signature, id, size, label."""
    bits = sets.select("id", "bits")
    full = rows.groupBy("signature").agg(F.count("*").alias("n")).where(F.col("n") > FULL).select("signature")
    split = split_buckets(rows.join(full, "signature", "left_semi").join(bits, "id"), num, den)
    rows = materialize(rows.join(full, "signature", "left_anti").withColumn("larger", F.lit(False)).select(split.columns)
                       .unionByName(split), "jaccard-open")
    common = (rows.groupBy("signature", "label").agg(F.count("*").alias("n")).groupBy("signature")
              .agg(F.max_by("label", F.struct("n", "label")).alias("common"), F.count("*").alias("labels")).where("labels > 1")
              .select("signature", "common"))
    met = rows.join(common, "signature").join(bits, "id")

    def side(mark):
        return [F.col(c).alias(c + mark) for c in ("id", "size", "label", "larger", "bits")]

    differ = sum((F.bit_count(F.col("bits_a")[k].bitwiseXOR(F.col("bits_b")[k])) for k in range(BITS // 64)), F.lit(0))
    a = met.where("label <> common").select("signature", *side("_a"))
    b = met.select(F.col("signature").alias("signature_b"), "common", *side("_b"))
    pairs = a.join(b, (F.col("signature") == F.col("signature_b"))
                   & ((F.col("label_b") == F.col("common")) | (F.col("label_a") < F.col("label_b")))
                   & ~(F.col("larger_a") & F.col("larger_b")) & _fits("size_a", "size_b", num, den)
                   & (differ * (den + num) <= (F.col("size_a") + F.col("size_b")) * (den - num)))
    return pairs.select(F.greatest("id_a", "id_b").alias("a"), F.least("id_a", "id_b").alias("b")).distinct()


def _verified(pairs: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({
                "id": b.column("id"), "set": pa.array([shingles(t, n).view(np.int64) for t in b.column("text").to_pylist()],
                                                      pa.list_(pa.int64()))})

    sets = materialize(docs.join(wanted, "id", "left_semi").dropDuplicates(["id"])
                       .mapInArrow(run, "id bigint, set array<bigint>"), "jaccard-sets")
    both = (pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b"))
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common * den >= (F.size("x") + F.size("y") - common) * num).select("a", "b")


def _fits(a: str, b: str, num: int, den: int):
    return (F.col(a) * den >= F.col(b) * num) & (F.col(b) * den >= F.col(a) * num)


def link_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, num: int = 80,
                    den: int = 100) -> DataFrame:
    """(id, n_shingles, component) of every row; component is the smallest id it is linked with."""
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    parts = max(8, total_bytes(source) // PART_BYTES) | 1
    with shuffle_files_freed(spark):
        sets = materialize(document_sets(source, n), "jaccard-sets")
        alive = sets.where("size > 0 AND id IS NOT NULL")
        keys = materialize(alive.groupBy("key").agg(F.min("id").alias("representative")), "jaccard-keys")
        chosen = keys.select(F.col("representative").alias("id"))
        representatives = (source.join(chosen, "id", "left_semi").dropDuplicates(["id"])
                           .withColumn("part", F.pmod("id", F.lit(parts)).cast("bigint")))
        rows = materialize(_signature_rows(representatives, n, num, den, parts), "jaccard-signatures")
        own = materialize(alive.join(chosen, "id", "left_semi").dropDuplicates(["id"]).select("id", "size", "bits"), "jaccard-bits")
        centre = rows.groupBy("signature").agg(F.min(F.struct("id", "size")).alias("c"), F.count("*").alias("n")).where("n > 1")
        nearest = (rows.join(centre, "signature").where((F.col("id") > F.col("c.id")) & _fits("size", "c.size", num, den))
                   .groupBy("id").agg(F.min("c.id").alias("b")))
        first = materialize(nearest.select(F.col("id").alias("a"), "b"), "jaccard-pairs")
        links = materialize(_verified(_may_link(first, own, num, den), source, n, num, den), "jaccard-links")
        label = materialize(components(links), "jaccard-labels")
        labelled = rows.join(label, "id", "left").select("signature", "id", "size", F.coalesce("component", "id").alias("label"))
        mixed = (labelled.groupBy("signature").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
                 .select("signature"))
        open_rows = materialize(labelled.join(mixed, "signature", "left_semi"), "jaccard-open")
        pairs = _open_pairs(open_rows, own, num, den)
        second = materialize(pairs.join(first, ["a", "b"], "left_anti"), "jaccard-pairs")
        more = materialize(_verified(second, source, n, num, den), "jaccard-links")
        label = materialize(components(links.union(more)), "jaccard-labels")
    final = keys.join(label, keys.representative == label.id, "left").select(
        "key", F.coalesce("component", "representative").alias("component"))
    return sets.select("id", "size", F.when(F.col("size") > 0, F.col("key")).alias("key")).join(final, "key", "left").select(
        "id", F.col("size").cast("bigint").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))
