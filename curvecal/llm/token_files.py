"""Token ids of a corpus as flat unsigned integer files with 64-bit document offsets.

Documents are ordered by key over range partitions. Each partition encodes its documents and
writes a pair of files while it goes: ``.bin``, nothing but little-endian ids (16 bits where
the vocabulary allows it, else 32), and ``.idx``, 64-bit offsets of its documents within the
pair, one more than there are documents. A table beside them names each document's file and
place, and a small table holds each pair's base, the prefix sum of the ids and documents of
all pairs before it. Readers map the files into memory and slice them.

Files carry the attempt in their name and count only if the attempt's rows were committed with
the table, so a lost executor or a repeated task leaves at most files nobody refers to.

A null text is an empty one. Rows of one key stay separate, ordered by the text's hash and the
text; null keys come first. Other columns take no part. An empty table gives files of no
document. A text of any length is encoded whole: it is cut only before ASCII white space that
follows a character which is no white space, where no token of a byte-level vocabulary with
the usual split pattern can cross, and stretches between such places are looked up or given
to the library.
"""

import itertools
import os
import re
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curvecal.session import attach, new_path

WINDOW = 1 << 20  # characters cut into stretches at a time
REMEMBERED = 500_000  # stretches, and
REMEMBERED_CHARS = 8 << 20  # their characters, that a worker keeps at most before it starts anew
RUN_ON = 2_000  # stretches given to the library as one text
READ_BYTES = 16 << 20

ASCII_SPACE = " \t\n\r\x0b\x0c"
STRETCH = re.compile(f"[{ASCII_SPACE}]*[^{ASCII_SPACE}]+|[{ASCII_SPACE}]+")
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
PLACE = re.compile(f"(?<=\\S)(?=[{ASCII_SPACE}])")


class TokenFiles(NamedTuple):
    """A written corpus: its folder, one row per document, one row per pair of files."""

    folder: str
    documents: DataFrame
    bases: DataFrame


def windows(text: str, size: int = WINDOW):
    """Parts of a text of about ``size`` characters, cut where no token crosses."""
    at = 0
    while len(text) - at > size:
        cut = PLACE.search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


def stretches(text: str) -> list[str]:
    """A text cut wherever no token crosses; the pieces joined are the text."""
    return PLACE.split(text) if OTHER_SPACE.search(text) else STRETCH.findall(text)


class _Numbers(dict):
    """Numbers stretches in order of appearance and lists those it had not met."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, piece):
        self[piece] = n = len(self)
        self.fresh.append(piece)
        return n


class Coder:
    """Ids of texts, by the tokenizers library, which sees each different stretch once while it is remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if len(vocabulary) <= 1 << 16 else "<u4")
        # a byte-level token has a character for each of its bytes
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.chars = _Numbers(), 0
        self.first, self.width = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.known = np.zeros(0, self.kind)

    def _run_on(self, pieces: list[str]):
        """Ids and widths of stretches that may stand one behind the other: the library is called for many at once."""
        size = np.array([len(p) if p.isascii() else len(p.encode()) for p in pieces])
        joined = ["".join(pieces[at:at + RUN_ON]) for at in range(0, len(pieces), RUN_ON)]
        coded = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, self.kind) for e in coded])
        ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(size)) + 1
        if int(self.bytes[ids].sum()) != int(size.sum()):
            raise ValueError("not a byte-level vocabulary")
        return ids, np.diff(ends, prepend=0)

    def _learn(self) -> None:
        """Ids of the stretches met for the first time."""
        fresh, self.numbers.fresh = self.numbers.fresh, []
        if not fresh:
            return
        self.chars += sum(map(len, fresh))
        alone = [p[0] not in ASCII_SPACE or p[-1].isspace() for p in fresh]
        width, parts = np.zeros(len(fresh), np.int64), []
        single = [p for p, a in zip(fresh, alone) if a]
        alone = np.array(alone)
        if single:
            coded = self.tokenizer.encode_batch_fast(single, add_special_tokens=False)
            width[alone] = [len(e) for e in coded]
            parts += [np.array(e.ids, self.kind) for e in coded]
        if len(single) < len(fresh):
            ids, width[~alone] = self._run_on([p for p, a in zip(fresh, alone) if not a])
            parts.append(ids)
        first, order = np.zeros(len(fresh), np.int64), np.concatenate((np.flatnonzero(alone), np.flatnonzero(~alone)))
        first[order] = len(self.known) + np.cumsum(width[order]) - width[order]
        self.known = np.concatenate((self.known, *parts))
        self.first, self.width = np.concatenate((self.first, first)), np.concatenate((self.width, width))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, and how many each text has."""
        if len(self.numbers) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self._forget()
        number, order, size = self.numbers, [], []
        for text in texts:
            codes = [number[p] for p in stretches(text)]
            size.append(len(codes))
            order += codes
        self._learn()
        order = np.array(order, np.int64)
        each = self.width[order]
        end = np.cumsum(each)
        places = np.arange(end[-1] if len(end) else 0) + np.repeat(self.first[order] - (end - each), each)
        ends = np.concatenate(([0], end))[np.concatenate(([0], np.cumsum(size, dtype=np.int64)))]
        return self.known[places], np.diff(ends)


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """The coder of this worker process."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def _qualified(spark: SparkSession, folder: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _local(uri: str) -> str | None:
    return re.sub("^file:/*", "/", uri) if uri.startswith("file:") else None


def _create(uri: str):
    """Output stream of a new file on whatever file system the folder is on."""
    from pyarrow import fs

    local = _local(uri)
    system, path = (fs.LocalFileSystem(), local) if local else fs.FileSystem.from_uri(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    return system.open_output_stream(path)


class Mapped:
    """Slices of a flat file: mapped into memory, or read by range where it is not on a mounted file system."""

    def __init__(self, uri: str, kind: np.dtype):
        from pyarrow import fs

        local, self.kind = _local(uri), kind
        if local:
            self.rows = np.memmap(local, kind, "r") if os.path.getsize(local) else np.empty(0, kind)
        else:
            system, path = fs.FileSystem.from_uri(uri)
            self.rows, self.file = None, system.open_input_file(path)

    def __getitem__(self, part: slice) -> np.ndarray:
        if self.rows is not None:
            return np.asarray(self.rows[part])
        width = self.kind.itemsize
        return np.frombuffer(self.file.read_at((part.stop - part.start) * width, part.start * width), self.kind)


def write(docs: DataFrame, tokenizer: str, end_id: int | None = None, key: str = "doc_id", text: str = "text",
          folder: str | None = None, parts: int | None = None) -> TokenFiles:
    """Encode every whole text and write the ids in ascending order of the key, ``end_id`` after each document."""
    spark = docs.sparkSession
    spark.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)
    folder = _qualified(spark, folder or new_path(spark, "token-files"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ordered = plain.withColumn("hash", F.xxhash64("text")).repartitionByRange(parts, "key", "hash")
    ordered = ordered.sortWithinPartitions("key", "hash", "text").select("key", "text")
    schema = T.StructType([plain.schema["key"], T.StructField("file", T.StringType()), T.StructField("part", T.IntegerType()),
                           T.StructField("place", T.LongType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("width", T.IntegerType())])

    def run(batches):
        code, part = coder(SparkFiles.get(name)), TaskContext.get().partitionId()
        stop = np.array([] if end_id is None else [end_id], code.kind)
        file, ids, index, place, at = f"{folder}/ids/part-{part:05d}-{uuid.uuid4().hex}", None, None, 0, 0
        for batch in batches:
            if ids is None:
                ids, index = _create(f"{file}.bin"), _create(f"{file}.idx")
                index.write(np.zeros(1, "<i8").tobytes())
            texts = batch.column("text")
            size = np.zeros(len(texts), np.int64)
            for rows, last, flat, counts in _encoded(code, texts):
                np.add.at(size, rows, counts + len(stop) * np.array(last))
                begin = 0
                for n, ends in zip(counts, last):
                    ids.write(flat[begin:begin + n].tobytes())
                    begin += n
                    if ends:
                        ids.write(stop.tobytes())
            index.write((at + np.cumsum(size)).astype("<i8").tobytes())
            at += int(size.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array([file] * len(size)), pa.array([part] * len(size), pa.int32()),
                 pa.array(np.arange(place, place + len(size))), pa.array(size),
                 pa.array([code.kind.itemsize] * len(size), pa.int32())], names=schema.names)
            place += len(size)
        if ids is not None:
            ids.close()
            index.close()

    ordered.mapInArrow(run, schema).write.parquet(f"{folder}/documents")
    written = spark.read.schema(schema).parquet(f"{folder}/documents")
    # one row per pair of files reaches the driver
    pairs = written.groupBy("part", "file").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("ids")).orderBy("part").collect()
    before = itertools.accumulate(((p.n, p.ids) for p in pairs), lambda a, b: (a[0] + b[0], a[1] + b[1]), initial=(0, 0))
    bases = [(p.file, p.n, p.ids, *base) for p, base in zip(pairs, before)]
    spark.createDataFrame(bases, "file string, n_docs bigint, n_tokens bigint, doc_base bigint, token_base bigint").coalesce(
        1).write.parquet(f"{folder}/bases")
    return open_files(spark, folder)


def _encoded(code: Coder, texts: pa.Array):
    """Row numbers, whether the row ends there, ids and their numbers, for about a window of characters at a time."""
    rows, last, held, size = [], [], [], 0
    for row, value in enumerate(texts):
        cut = list(windows(value.as_py()))
        for i, window in enumerate(cut):
            rows.append(row)
            last.append(i + 1 == len(cut))
            held.append(window)
            size += len(window)
            if size >= WINDOW:
                yield rows, last, *code.encode(held)
                rows, last, held, size = [], [], [], 0
    if rows:
        yield rows, last, *code.encode(held)


def open_files(spark: SparkSession, folder: str) -> TokenFiles:
    """A corpus that ``write`` left in a folder."""
    folder = _qualified(spark, folder)
    return TokenFiles(folder, spark.read.parquet(f"{folder}/documents"), spark.read.parquet(f"{folder}/bases"))


def read(files: TokenFiles) -> DataFrame:
    """(key, place, start, n_tokens, ids) of every document, from the mapped files.

    ``place`` and ``start`` count all documents and all ids before it. ``ids`` are bytes,
    little-endian unsigned 32-bit integers, of whatever width they are stored in.
    """
    rows = attach(files.documents.select("key", "file", "place", "width"), files.bases, ["file"], how="left").select(
        "key", "file", (F.col("place") + F.col("doc_base")).alias("place"), "place", "width", "token_base").toDF(
        "key", "file", "place", "own", "width", "token_base")
    schema = T.StructType([rows.schema["key"], T.StructField("place", T.LongType()), T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches):
        opened, ids, index = None, None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("file", "own", "width", "token_base")]
            first, held, starts, sizes, sliced = 0, 0, [], [], []
            for row, (file, own, width, base) in enumerate(zip(*columns)):
                if file != opened:
                    opened, ids = file, Mapped(f"{file}.bin", np.dtype(f"<u{width}"))
                    index = Mapped(f"{file}.idx", np.dtype("<i8"))
                begin, end = index[own:own + 2].tolist()
                starts.append(base + begin)
                sizes.append(end - begin)
                sliced.append(ids[begin:end].astype("<u4").tobytes())
                held += 4 * (end - begin)
                if held >= READ_BYTES or row + 1 == batch.num_rows:
                    part = batch.slice(first, row + 1 - first)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("key"), part.column("place"), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()),
                         pa.array(sliced, pa.binary())], names=schema.names)
                    first, held, starts, sizes, sliced = row + 1, 0, [], [], []

    return rows.mapInArrow(run, schema)
