"""Token-id files as directly addressable codes.

A file is a Parquet folder in which a row holds one segment: the ids of a run of whole
documents.  An id is split into 8-bit chunks, lowest first.  Level 0 has one chunk of every
id; level k + 1 has a chunk of those ids only whose continuation bit of level k is set.  A rank
directory (set bits before each block of 512) turns a position of one level into the position
of the next, so any token is read by one step a level, without decoding a block.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import kept
from ledgerlens.llm.tokens import encoder

#: fixed value: first bytes of a segment
MAGIC = b"DAC1"
#: bits of a rank-directory block
RANK_BLOCK = 512
#: a segment is closed by the first document that brings it to so many ids
SEGMENT_TOKENS = 1 << 20
#: names of segments that are broadcast at most
BROADCAST_SEGMENTS = 100_000


def pack_segment(ids: np.ndarray) -> bytes:
    """The bytes of a segment: magic, number of levels; per level the number of chunks, chunks,
    continuation bits (whole blocks) and rank directory."""
    values, levels = ids.astype(np.uint32), []
    while True:
        more = values > 0xFF
        chunks = (values & 0xFF).astype(np.uint8)
        blocks = -(-len(values) // RANK_BLOCK)
        bits = np.zeros(blocks * RANK_BLOCK, np.uint8)
        bits[:len(more)] = more
        ones = np.cumsum(bits.reshape(blocks, RANK_BLOCK).sum(axis=1, dtype=np.int64))
        rank = np.concatenate([[0], ones[:-1]])[:blocks].astype("<u4")
        levels.append(struct.pack("<Q", len(values)) + chunks.tobytes()
                      + np.packbits(bits, bitorder="little").tobytes() + rank.tobytes())
        values = values[more] >> 8
        if not len(values):
            return MAGIC + bytes([len(levels)]) + b"".join(levels)


class Segment:
    """Random access to the ids of a segment."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("no token segment")
        self.levels, at = [], 5
        for _ in range(blob[4]):
            n, = struct.unpack_from("<Q", blob, at)
            blocks = -(-n // RANK_BLOCK)
            chunks = np.frombuffer(blob, np.uint8, n, at + 8)
            bits = np.frombuffer(blob, np.uint8, blocks * RANK_BLOCK // 8, at + 8 + n)
            at += 8 + n + blocks * RANK_BLOCK // 8
            self.levels.append((chunks, bits, np.frombuffer(blob, "<u4", blocks, at)))
            at += 4 * blocks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def get(self, positions: np.ndarray) -> np.ndarray:
        """Ids at the given positions, each by a step a level."""
        at = np.asarray(positions, np.int64)
        out, which = np.zeros(len(at), np.uint32), np.arange(len(at))
        for level, (chunks, bits, rank) in enumerate(self.levels):
            out[which] |= chunks[at].astype(np.uint32) << np.uint32(8 * level)
            more = (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            which, at = which[more], at[more]
            if not len(at):
                break
            block = bits.reshape(-1, RANK_BLOCK // 8)[at // RANK_BLOCK]
            inside = np.unpackbits(block, axis=1, bitorder="little")
            before = np.arange(RANK_BLOCK) < (at % RANK_BLOCK)[:, None]
            at = rank[at // RANK_BLOCK].astype(np.int64) + (inside & before).sum(axis=1, dtype=np.int64)
        return out

    def all(self) -> np.ndarray:
        """All ids in order: the levels from the last to the first."""
        values = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            more = np.unpackbits(bits, bitorder="little")[:len(chunks)].astype(bool)
            below, values = values, chunks.astype(np.uint32)
            values[more] |= below << np.uint32(8)
        return values


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int,
                      segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encodes ``docs(doc_id, text)`` in ascending doc_id order and writes segments to ``path``.

    Rows are range-partitioned and sorted by doc_id (null first, equal ids by text) before the
    texts are encoded, so a task holds one batch of texts and one open segment.  A null text is
    empty; every document ends with ``end_id``; further columns are ignored; no rows give an
    empty folder of the same schema.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq, first = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        held, names, lens, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal seq, first, held, names, lens, size
            out = pa.record_batch({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                "first": pa.array([first], pa.int64()), "n": pa.array([size], pa.int64()),
                "doc_ids": pa.array([names], pa.list_(pa.int64())),
                "lengths": pa.array([lens], pa.list_(pa.int64())),
                "blob": pa.array([pack_segment(np.concatenate(held))], pa.binary())})
            seq, first, held, names, lens, size = seq + 1, first + size, [], [], [], 0
            return out

        for b in batches:
            doc_ids = b.column("doc_id").to_pylist()
            for at, ids, bounds in enc.encode(b.column("text")):
                ends = np.arange(1, len(bounds)) + bounds[1:]           # with the end ids
                whole = np.insert(ids.astype(np.uint32), bounds[1:], end_id)
                start = 0
                while start < len(ends):
                    base = ends[start - 1] if start else 0
                    to = int(np.searchsorted(ends, base + segment_tokens - size)) + 1
                    to = min(to, len(ends))
                    held.append(whole[base:ends[to - 1]])
                    names += doc_ids[at + start:at + to]
                    lens += np.diff(np.concatenate([[base], ends[start:to]])).tolist()
                    size += int(ends[to - 1] - base)
                    start = to
                    if size >= segment_tokens:
                        yield close()
        if size:
            yield close()

    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
     .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(run, "part int, seq int, first long, n long, doc_ids array<long>, "
                      "lengths array<long>, blob binary")
     .write.option("compression", "zstd").parquet(path))


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``start``, the ids of all segments before them."""
    rows = spark.read.parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n").alias("total"))
    # one row a written partition; the segments of a partition know their place in it
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return rows.join(parts, "part").withColumn("start", F.col("base") + F.col("first"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document of the files; ``ids`` is binary,
    little-endian unsigned 32-bit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids = Segment(b.column("blob")[i].as_py()).all().astype("<u4")
                lens = np.asarray(b.column("lengths")[i].values, np.int64)
                ends = np.cumsum(lens)
                starts = ends - lens + b.column("start")[i].as_py()
                offsets = np.concatenate([[0], ends * 4]).astype(np.int32)
                yield pa.record_batch({
                    "doc_id": b.column("doc_ids")[i].values, "start": pa.array(starts),
                    "n_tokens": pa.array(lens),
                    "ids": pa.Array.from_buffers(pa.binary(), len(lens),
                                                 [None, pa.py_buffer(offsets), pa.py_buffer(ids)])})

    return (_segments(spark, path).select("start", "doc_ids", "lengths", "blob")
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary"))


def tokens_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Random access: ``wanted(position)``, positions in the whole token stream, ->
    ``(position, token)``.  Segments answer for the positions they hold, and only segments that
    are asked for are shuffled; positions outside the stream have no row, repeated positions
    have a row each."""
    import pandas as pd

    # segments are listed under the stretches of the stream that they touch: an equi-join
    stretch = F.lit(SEGMENT_TOKENS)
    end = F.col("start") + F.col("n")
    places = _segments(spark, path).select("part", "seq", "start", end.alias("end"), F.explode(F.sequence(
        F.floor(F.col("start") / stretch), F.floor((end - 1) / stretch))).alias("stretch"))
    asked = wanted.select("position", F.floor(F.col("position") / stretch).alias("stretch"))
    found = kept(asked.join(places, "stretch").where("position >= start and position < end")
                 .select("part", "seq", "start", "position"))
    named = found.select("part", "seq", "start").distinct()
    segments = spark.read.parquet(path).select("part", "seq", "blob").join(
        F.broadcast(named) if named.count() <= BROADCAST_SEGMENTS else named, ["part", "seq"])

    def run(seg: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        if not len(seg) or not len(want):
            return pd.DataFrame({"position": [], "token": []})
        at = want["position"].to_numpy(np.int64)
        got = Segment(seg["blob"].iloc[0]).get(at - int(seg["start"].iloc[0]))
        return pd.DataFrame({"position": at, "token": got.astype(np.int64)})

    return (segments.groupBy("part", "seq")
            .cogroup(found.select("part", "seq", "position").groupBy("part", "seq"))
            .applyInPandas(run, "position long, token long"))
