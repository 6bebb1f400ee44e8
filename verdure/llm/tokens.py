"""Token ids in Arrow files: fixed-size-list batches of equal-length sequences and masks.

Documents are range-partitioned by id; every partition writes its concatenated ids as one Arrow
file of equal-length sequences.  A row holds ``ids`` (fixed-size list of unsigned integers),
``mask`` (fixed-size list of bytes, 1: a real id, 0: padding after the shard's end), ``ends`` (places
of the documents' last ids in the row) and ``doc_ids`` (the documents that end there).  All batches of a
file but its last one hold the same number of rows, so sequence k is row k % rows of batch k // rows:
``SequenceFile`` gives it as views of a memory map.  Masks are dictionary-coded, as a file has two of
them at most: all real, and the last row's.

Recovery: a task writes a file under a name of its own and returns it as a row; the rows that
Spark commits (reliable checkpoint) are the manifest, files of lost or repeated attempts are in
none.  Memory: one Arrow batch, one block of sequences and several numbers of eight bytes for each byte of
the piece in work (``BLOCK_BYTES``, or one longer text) a task.

Defined results: a null text is empty (its end id only); documents stand in ascending id, null
ids first, equal ids by text hash; repeated rows are documents of their own; no documents give an
empty manifest; further columns are ignored, whatever their names; long texts are encoded whole.
"""
from __future__ import annotations

import re
import zlib
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, ensure_checkpoint_dir
from .common import text_of
from .hashing import ChunkTable, chunk_starts, per_text, raw_bytes, slices

SEQUENCE = 2048
ROWS_PER_BATCH = 256
END_ID = 0
BLOCK_BYTES = 2 << 20
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
#: UTF-8 of U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F and U+3000.
WIDE_SPACES = [0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080]

_LOADED: dict = {}


def _blank_edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes that begin, bytes that end a white-space character of Unicode, or one that Python counts as such)."""
    begin = ASCII_SPACE[data]
    end = begin.copy()
    n = len(data)
    if n > 1:
        two = np.flatnonzero((data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0)))
        begin[two] = end[two + 1] = True
    if n > 2:
        lead = np.flatnonzero((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3))
        code = (data[lead].astype(np.int32) << 16) | (data[lead + 1].astype(np.int32) << 8) | data[lead + 2]
        three = lead[np.isin(code, WIDE_SPACES)]
        begin[three] = end[three + 2] = True
    return begin, end


class Encoder:
    """The tokenizers library, asked once per distinct chunk of a worker's stream.

    Byte-level pre-tokens never end in a blank between two visible characters and never reach over one, so a text
    is the concatenation of the chunks cut in front of such blanks, encoded one by one.  Strings of special tokens in a
    text get the special ids, as in the library, or with ``special_as_text`` the ids of ordinary text."""

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = special_as_text
        # an added token that holds white space, or takes some beside it, could reach over a cut
        self.whole = any(t.lstrip or t.rstrip or re.search(r"\s", t.content) for t in self.lib.get_added_tokens_decoder().values())
        self.dtype = np.dtype("<u2") if self.lib.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.table = ChunkTable(self.dtype, self._ask)

    def _ask(self, chunks: list[tuple[bytes, int]]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch_fast([c.decode() for c, _ in chunks], add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids per text)."""
        data, at = raw_bytes(texts)
        blank = np.flatnonzero(data == 0x20)
        blank = blank[(blank > 0) & (blank < len(data) - 1)]
        begin, end = _blank_edges(data)
        inside = np.ones(len(data), bool)
        inside[at[:-1][at[:-1] < len(data)]] = False  # a text's first byte
        cuts = blank[inside[blank] & inside[blank + 1] & ~end[blank - 1] & ~begin[blank + 1]]
        cuts = cuts[:0] if self.whole else cuts
        first, leads = chunk_starts(at, cuts, len(data))
        ids, size = self.table.encode(data, first, np.zeros(len(first), np.int64))
        return ids, per_text(first, size, at)


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    key = (path, special_as_text)
    if key not in _LOADED:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _LOADED[key] = Encoder(path, special_as_text)
    return _LOADED[key]


def _uri(path: str) -> str:
    return re.sub(r"^file:/+", "file:///", path)


def _schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.dictionary(pa.int8(), pa.list_(pa.uint8(), length))),
                      ("ends", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64()))])


class _Shard:
    """Writes one Arrow file, ``rows`` sequences at a time."""

    def __init__(self, path: str, dtype: np.dtype, length: int, rows: int):
        from pyarrow import fs

        self.dtype, self.length, self.rows, self.schema = dtype, length, rows, _schema(dtype, length)
        files, name = fs.FileSystem.from_uri(path)
        self.sink = files.open_output_stream(name)
        # the last row's mask is known at the end only: it is added to the masks written before
        self.file = pa.ipc.new_file(self.sink, self.schema, options=pa.ipc.IpcWriteOptions(emit_dictionary_deltas=True))
        self.parts: list[bytes] = []
        self.waiting, self.total, self.n_sequences = 0, 0, 0
        self.open_ends: list[tuple[int, int | None]] = []  # (place of the end id in the waiting ids, document)

    def add(self, doc_id: int | None, coded: bytes) -> None:
        n = len(coded) // self.dtype.itemsize
        self.parts.append(coded)
        self.waiting += n
        self.total += n
        self.open_ends.append((self.waiting - 1, doc_id))
        if self.waiting >= self.length * self.rows:
            self._flush(self.length * self.rows)

    def _flush(self, least: int) -> None:
        """Writes batches of full size while ``least`` ids or more are waiting."""
        ids, size, at, done = np.frombuffer(b"".join(self.parts), self.dtype), self.length * self.rows, 0, 0
        while at < len(ids) and len(ids) - at >= least:
            stop = done
            while stop < len(self.open_ends) and self.open_ends[stop][0] < at + size:
                stop += 1
            self._batch(ids[at:at + size], [(p - at, d) for p, d in self.open_ends[done:stop]])
            at, done = at + size, stop
        self.parts = [ids[at:].tobytes()] if at < len(ids) else []
        self.waiting = max(0, len(ids) - at)
        self.open_ends = [(p - at, d) for p, d in self.open_ends[done:]]

    def _batch(self, ids: np.ndarray, ends: list[tuple[int, int | None]]) -> None:
        rows = -(-len(ids) // self.length)
        padding = rows * self.length - len(ids)
        which, masks = np.zeros(rows, np.int8), np.ones(self.length * (2 if padding else 1), np.uint8)
        if padding:
            ids = np.concatenate([ids, np.zeros(padding, self.dtype)])
            which[-1], masks[-padding:] = 1, 0
        place = np.array([p for p, _ in ends], np.int64)
        offsets = pa.array(np.searchsorted(place, np.arange(rows + 1) * self.length).astype(np.int32))
        self.file.write_batch(pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length),
             pa.DictionaryArray.from_arrays(pa.array(which), pa.FixedSizeListArray.from_arrays(pa.array(masks), self.length)),
             pa.ListArray.from_arrays(offsets, pa.array((place % self.length).astype(np.int32))),
             pa.ListArray.from_arrays(offsets, pa.array([d for _, d in ends], pa.int64()))], schema=self.schema))
        self.n_sequences += rows

    def close(self) -> None:
        self._flush(1)
        self.file.close()
        self.sink.close()


def write(docs: DataFrame, tokenizer_path: str, folder: str | None = None, *, sequence: int = SEQUENCE, rows: int = ROWS_PER_BATCH,
          end_id: int = END_ID, shards: int | None = None, special_as_text: bool = True) -> DataFrame:
    """Writes ``docs`` (doc_id, text) and returns the manifest: shard, path, n_tokens, n_sequences, first (ids in all shards before).
    With ``special_as_text`` off, a special token's string in a text gets its special id, as the library gives it."""
    spark = docs.sparkSession
    folder = _uri(folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-ids-{uuid4().hex}")
    from pyarrow import fs
    files, name = fs.FileSystem.from_uri(folder)
    files.create_dir(name, recursive=True)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    # the text hash tells equal and null ids apart, so that no id makes a partition of its own
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    src = (src.repartitionByRange(shards, *order) if shards else src.repartitionByRange(*order)).sortWithinPartitions(*order)

    def run(batches):
        from pyspark import TaskContext

        e, shard = encoder(tokenizer_path, special_as_text), None
        end = np.array([end_id], e.dtype).tobytes()
        k = TaskContext.get().partitionId()
        path = f"{folder}/shard-{k:06d}-{uuid4().hex}.arrow"
        for batch in batches:
            if batch.num_rows and shard is None:
                shard = _Shard(path, e.dtype, sequence, rows)
            for piece in slices(batch, "text", BLOCK_BYTES):
                ids, n = e.encode(piece.column("text"))
                stops = np.cumsum(n).tolist()
                for doc_id, a, b in zip(piece.column("doc_id").to_pylist(), [0, *stops], stops):
                    shard.add(doc_id, ids[a:b].tobytes() + end)
        if shard is not None:
            shard.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([k], pa.int64()), "path": [path], "n_tokens": pa.array([shard.total], pa.int64()),
                                               "n_sequences": pa.array([shard.n_sequences], pa.int64())})

    made = cut_lineage(src.mapInArrow(run, "shard long, path string, n_tokens long, n_sequences long"))
    # one row a file: their order is all that a single task sees
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return made.withColumn("first", F.coalesce(before, F.lit(0)))


def read_documents(manifest: DataFrame) -> DataFrame:
    """Documents of the files in ``manifest``: doc_id, start, n_tokens, ids_crc32 (ids as unsigned 32-bit integers)."""

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
                files, name = fs.FileSystem.from_uri(path)
                with files.open_input_file(name) as f:
                    reader = pa.ipc.open_file(f)
                    start, crc, n = first, 0, 0
                    for i in range(reader.num_record_batches):
                        b = reader.get_batch(i)
                        ids = b.column("ids").flatten().to_numpy()
                        which, masks = _masks(b)
                        real = int(masks.sum(axis=1)[which].sum())
                        row = np.repeat(np.arange(b.num_rows), b.column("ends").value_lengths().to_numpy())
                        ends = row * masks.shape[1] + b.column("ends").flatten().to_numpy()
                        owners = b.column("doc_ids").flatten().to_pylist()
                        wide, at, out = np.ascontiguousarray(ids[:real].astype("<u4")), 0, []
                        for doc_id, end in zip(owners, ends.tolist()):
                            crc = zlib.crc32(wide[at:end + 1], crc)
                            n += end + 1 - at
                            out.append((doc_id, start, n, crc))
                            start, crc, n, at = start + n, 0, 0, end + 1
                        crc, n = zlib.crc32(wide[at:], crc), n + real - at
                        columns = list(zip(*out)) or [[], [], [], []]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                                         names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # a file a task: paths are dealt out in turn
    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    return (manifest.repartition(4 * n, "path").mapInArrow(run, T.StructType(
        [T.StructField(c, T.LongType()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])))


def _masks(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(number of every row's mask, the masks as a 2-D array): views, no copies."""
    m = batch.column("mask")
    return m.indices.to_numpy(zero_copy_only=True), m.dictionary.flatten().to_numpy(zero_copy_only=True).view(bool).reshape(len(m.dictionary), -1)


class SequenceFile:
    """Random access for training jobs: ``file[k]`` is ``(ids, mask)`` of sequence k, read-only views without a copy
    (ids lie in the memory map; masks are the file's two, read once)."""

    def __init__(self, path: str):
        self.map = pa.memory_map(path)
        self.reader = pa.ipc.open_file(self.map)
        n = self.reader.num_record_batches
        self.rows = self.reader.get_batch(0).num_rows if n else 0
        self.size = (n - 1) * self.rows + self.reader.get_batch(n - 1).num_rows if n else 0

    def __len__(self) -> int:
        return self.size

    def batch(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids as a 2-D array, number of every row's mask, masks as a 2-D array) of batch ``i``."""
        b = self.reader.get_batch(i)
        ids = b.column("ids")
        return ids.flatten().to_numpy(zero_copy_only=True).reshape(len(ids), -1), *_masks(b)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if not -self.size <= k < self.size:
            raise IndexError(k)
        i, row = divmod(k % self.size, self.rows)
        ids, which, masks = self.batch(i)
        return ids[row], masks[which[row]]


def sequences(path: str):
    """All ``(ids, mask)`` of a file in order."""
    file = SequenceFile(path)
    for i in range(file.reader.num_record_batches):
        ids, which, masks = file.batch(i)
        yield from ((ids[row], masks[which[row]]) for row in range(len(ids)))
