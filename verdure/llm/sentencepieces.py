"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is escaped (blank to U+2581, one in front) and cut before every run of U+2581.  No piece
of such a vocabulary crosses those cuts (checked when the model is loaded), so the segments are
encoded one by one and the same segment only once.  A segment starts as single characters; an
agenda holds the adjacent pairs that make a piece, best score first, leftmost first among equals;
the head is merged and its new neighbours enter the agenda.  What is no piece at the end falls
back to bytes.  In every Arrow batch the segments met for the first time are also encoded by the
sentencepiece library, and a difference ends the task.

Scale: a narrow map over Arrow batches, no shuffle; a worker keeps a bounded table of segments, looked up for
a whole block of texts at once.

Defined results: a null text is empty (begin and end id only); repeated rows get the same ids;
extra columns are carried as they are.
"""
from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh
from .hashing import ChunkTable, chunk_starts, per_text, raw_bytes, slices

MARK = "▁"
BLOCK_BYTES = 2 << 20

_LOADED: dict = {}


class Codec:
    """Agenda encoder of one model, with the library beside it for checks and decoding."""

    def __init__(self, path: str):
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.lib = spm.SentencePieceProcessor(model_file=path)
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, trained = proto.normalizer_spec, proto.trainer_spec
        if trained.model_type != trained.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces \
                or not norm.add_dummy_prefix or not norm.escape_whitespaces or trained.treat_whitespace_as_suffix:
            raise ValueError("a merge-type model with plain normalisation and a blank in front is needed")
        kinds = pb.ModelProto.SentencePiece
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.score = [p.score for p in proto.pieces]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.unknown = self.lib.unk_id()
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces that cross words are not supported")
        if len(self.score) > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.table = ChunkTable("<u2", self._ask)

    def segment(self, text: str) -> list[int]:
        """Ids of one escaped segment, by the agenda."""
        ids, score = self.ids, self.score
        symbols: list[str | None] = list(text)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[float, int, int, str]] = []

        def propose(left: int, right: int) -> None:
            pair = symbols[left] + symbols[right]
            if (i := ids.get(pair)) is not None:
                heapq.heappush(agenda, (-score[i], left, right, pair))

        for i in range(n - 1):
            propose(i, i + 1)
        while agenda:
            _, left, right, pair = heapq.heappop(agenda)
            if symbols[left] is None or symbols[right] is None or after[left] != right or symbols[left] + symbols[right] != pair:
                continue  # one side was merged meanwhile
            symbols[left], symbols[right] = pair, None
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
                propose(left, after[left])
            if before[left] >= 0:
                propose(before[left], left)
        out: list[int] = []
        for s in symbols:
            if s is None:
                continue
            if (i := ids.get(s)) is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in s.encode())
            else:
                out.append(self.unknown)
        return out

    def _ask(self, chunks: list[tuple[bytes, int]]) -> list[list[int]]:
        """Encodes new chunks and checks them against the library.  A text's first chunk gets the mark in front."""
        segments = [(MARK if lead else "") + c.decode().replace(" ", MARK) for c, lead in chunks]
        mine = [self.segment(s) for s in segments]
        theirs = self.lib.encode([s[1:].replace(MARK, " ") for s in segments], num_threads=1)
        for s, a, b in zip(segments, mine, theirs):
            if s != MARK and a != b:  # the library gives nothing for an empty text
                raise ValueError(f"agenda and library differ on {s!r}: {a} and {b}")
        return mine

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, with begin and end ids; ids per text)."""
        data, at = raw_bytes(texts)
        # marks: a blank, or the three bytes of U+2581 itself
        begin, end = data == 0x20, data == 0x20
        if len(data) > 2:
            own = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
            begin[own] = end[own + 2] = True
        cuts = np.flatnonzero(begin)
        cuts = cuts[(cuts > 0) & ~end[cuts - 1]]
        first, leads = chunk_starts(at, cuts, len(data))
        ids, size = self.table.encode(data, first, leads)
        n = per_text(first, size, at)
        out = np.insert(ids, np.repeat(np.cumsum(n), 2), np.tile(np.array([self.lib.eos_id(), self.lib.bos_id()], self.table.dtype), len(n)))
        # the end of a text is followed by the begin of the next one
        return np.r_[np.array([self.lib.bos_id()], self.table.dtype), out[:-1]] if len(n) else ids, n + 2


def codec(path: str) -> Codec:
    if path not in _LOADED:
        _LOADED[path] = Codec(path)
    return _LOADED[path]


def _coded(batch: pa.RecordBatch, c: Codec):
    """(piece of the batch, its ids as unsigned 32-bit integers, ids per text); the text is the last column."""
    name = batch.schema.names[-1]
    for piece in slices(batch, name, BLOCK_BYTES):
        ids, n = c.encode(piece.column(name))
        yield piece, ids.astype("<u4"), n


def digests(docs: DataFrame, model_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_tokens``, SHA-256 of the ids and of the decoded text."""
    src = docs.select(*keep, F.col(text_col).cast("string").alias(fresh(docs, "__text")))
    schema = T.StructType([*src.select(*keep).schema.fields, T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        c = codec(model_path)
        for batch in batches:
            for piece, ids, n in _coded(batch, c):
                stops = np.cumsum(n).tolist()
                parts = [ids[a:b] for a, b in zip([0, *stops], stops)]
                decoded = [c.lib.decode(x.tolist()) for x in parts]
                yield pa.RecordBatch.from_arrays(
                    [*[piece.column(k) for k in keep], pa.array(n, pa.int64()),
                     pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in parts], pa.string()),
                     pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string())],
                    names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    return src.mapInArrow(run, schema)


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "piece_ids") -> DataFrame:
    """``docs`` with an array of ids; ``text_col`` becomes the decoded text (null stays null)."""
    keep = [c for c in docs.columns if c != text_col]
    src = docs.select(*keep, F.col(text_col).cast("string").alias(fresh(docs, "__text")))
    fields = [T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in docs.schema.fields]
    schema = T.StructType([*fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))])
    names = [*docs.columns, ids_col]

    def run(batches):
        c = codec(model_path)
        for batch in batches:
            for piece, ids, n in _coded(batch, c):
                offsets = np.r_[0, np.cumsum(n)]
                valid = piece.column(piece.num_columns - 1).is_valid().to_pylist()
                decoded = pa.array([c.lib.decode(ids[a:b].tolist()) if ok else None
                                    for a, b, ok in zip(offsets.tolist(), offsets[1:].tolist(), valid)], pa.string())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype("int32")), pa.array(ids.view("<i4")))
                columns = {k: piece.column(k) for k in keep} | {text_col: decoded, ids_col: lists}
                yield pa.RecordBatch.from_arrays([columns[k] for k in names], names=names)

    return src.mapInArrow(run, schema)
