"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens.  A round stands for a window of the mixture: in each round a
queue's credit grows by its quantum, the share of ``round_tokens`` that its target proportion
gives, and it is served the whole tokens of its credit; the fraction that is left, its deficit,
is carried to the next round.  Rounds are laid one after the other, queues in name order within
a round, and the token stream is cut into sequences.

With credits in fixed point the state after round r needs no earlier round: queue s has been
served ``min(total_s, r * quantum_s >> FRACTION)`` tokens.  So every task places its own
documents exactly, deficits carry over windows *and* partitions without any hand-over, and the
only exchange is a table of tokens per (chunk, queue).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import kept, stored
from ledgerlens.llm.tokens import Encoder, ragged, task_encoder

#: bits of the fraction of a credit
FRACTION = 14
#: tokens of a round, in sequences: one, so that every sequence has the target proportions
ROUND_SEQUENCES = 1
#: schedules of up to so many queues are held by the driver and every task; more queues (one a
#: source at any number) are placed by a sort, with the same result
MAX_QUEUES = 4096
#: (rounds x queues) cells computed at a time
CELLS = 1 << 21


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, queue) -> DataFrame:
    """Encodes every whole text once into a stored table: ``chunk`` (the task that wrote it),
    ``before`` (tokens of the same queue earlier in the chunk), ``n`` and ``ids``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_encoder(tokenizer) as enc:
            yield from encoded(enc, batches)

    def encoded(enc: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            queues = b.column("queue").to_pylist()
            for at, ids, bounds in enc.encode(b.column("text")):
                whole = np.insert(ids, bounds[1:], end_id).astype(enc.dtype)
                ends = np.arange(1, len(bounds)) + bounds[1:]
                lens = np.diff(np.concatenate([[0], ends]))
                before = []
                for q, n in zip(queues[at:at + len(lens)], lens.tolist()):
                    before.append(seen.get(q, 0))
                    seen[q] = before[-1] + n
                size = enc.dtype.itemsize
                offsets = np.concatenate([[0], ends * size]).astype(np.int32)
                yield pa.record_batch({
                    "doc_id": b.column("doc_id").slice(at, len(lens)),
                    "queue": b.column("queue").slice(at, len(lens)),
                    "chunk": pa.array(np.full(len(lens), chunk, np.int32)),
                    "before": pa.array(before, pa.int64()), "n": pa.array(lens, pa.int64()),
                    "width": pa.array(np.full(len(lens), size, np.int32)),
                    "ids": pa.Array.from_buffers(pa.binary(), len(lens),
                                                 [None, pa.py_buffer(offsets), pa.py_buffer(whole)])})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), queue.alias("queue"), "text")
    return stored(rows.mapInArrow(run, "doc_id long, queue string, chunk int, before long, n long, "
                                       "width int, ids binary"), "tokens")


class Shares:
    """The quantum of a queue, from its tokens, its weight and the sums over all queues."""

    def __init__(self, shares: float, least: float, unweighted: int, round_tokens: int):
        self.least = least / 1000                               # what has no weight still goes out
        self.total = shares + unweighted * self.least if unweighted else shares
        self.scale = round_tokens << FRACTION

    def quantum(self, share: float) -> int:
        return max(1, -int(-self.scale * (share if share > 0 else self.least) // self.total))


def served(total: np.ndarray, quantum: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    """Tokens that queues have been served after rounds."""
    return np.minimum(total, rounds * quantum >> FRACTION)


def round_of(quantum: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The round that serves a token."""
    return -((-(token + 1) << FRACTION) // quantum) - 1


def cut_at_rounds(token: np.ndarray, n: np.ndarray, total: np.ndarray, quantum: np.ndarray):
    """Pieces ``(document, round, start, end)`` of documents, each with its queue's total and quantum."""
    first, last = round_of(quantum, token), round_of(quantum, token + n - 1)
    doc = np.repeat(np.arange(len(n)), last - first + 1)
    rounds = ragged(first, last - first + 1)
    start = np.maximum(token[doc], served(total[doc], quantum[doc], rounds))
    end = np.minimum(token[doc] + n[doc], served(total[doc], quantum[doc], rounds + 1))
    some = end > start
    return doc[some], rounds[some], start[some], end[some]


class Schedule:
    """What each queue has been served after any round."""

    def __init__(self, totals: dict[str, int], quanta: dict[str, int]):
        self.names = sorted(q for q, n in totals.items() if n)
        self.index = {q: i for i, q in enumerate(self.names)}
        self.totals = np.array([totals[q] for q in self.names], np.int64)
        self.quantum = np.array([quanta[q] for q in self.names], np.int64)

    def served(self, queue: np.ndarray, rounds: np.ndarray) -> np.ndarray:
        return served(self.totals[queue], self.quantum[queue], rounds)

    def position(self, queue: np.ndarray, rounds: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Place of a token in the stream: all that earlier rounds served, what this round
        serves to the queues before its own, and its own rank in the round."""
        out, every = np.empty(len(rounds), np.int64), np.arange(len(self.names))
        distinct, where = np.unique(rounds, return_inverse=True)
        order = np.argsort(where, kind="stable")
        step, at = max(1, CELLS // max(1, len(every))), 0
        for lo in range(0, len(distinct), step):
            some = distinct[lo:lo + step, None]
            done, after = self.served(every, some), self.served(every, some + 1)
            before = done.sum(axis=1)[:, None] + np.cumsum(after - done, axis=1) - (after - done) - done
            to = int(np.searchsorted(where[order], lo + step))
            mine = order[at:to]
            out[mine] = before[where[mine] - lo, queue[mine]] + token[mine]
            at = to
        return out


def pack(docs: DataFrame, tokenizer: str, end_id: int, sequence_tokens: int = 1024,
         round_tokens: int | None = None, weights: dict[str, float] | None = None,
         source: str = "source", max_queues: int = MAX_QUEUES) -> DataFrame:
    """Pieces of all documents: ``(doc_id, source, start, length, doc_tokens, sequence_id,
    offset, padded_to, ids)``; ``ids`` is binary, little-endian unsigned 32-bit.

    ``weights`` are target token proportions by source; by default the sources' shares of all
    tokens, so that all queues run dry together.  When a queue is dry the others go on.  Every
    id, each document's end id included, lies in exactly one piece; all sequences are full but
    the last one, which is padded to a power of two.  A null text is empty (its end id only); a
    null source is the queue of the empty name; repeated rows are packed each; further columns
    are ignored; no rows give no pieces.
    """
    round_tokens = round_tokens or ROUND_SEQUENCES * sequence_tokens
    name = F.coalesce(F.col(source).cast("string"), F.lit(""))
    table = tokenized(docs, tokenizer, end_id, name)
    per_chunk = table.groupBy("chunk", "queue").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("queue").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_chunk.select("chunk", "queue", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    queues = per_chunk.groupBy("queue").agg(F.sum("n").alias("total"))
    if weights:
        given = docs.sparkSession.createDataFrame([(q, float(w)) for q, w in weights.items()], "queue string, share double")
        queues = queues.join(given, "queue", "left").withColumn("share", F.greatest("share", F.lit(0.0)))
        queues = queues.withColumn("share", F.coalesce("share", F.lit(0.0)))
    else:
        queues = queues.withColumn("share", F.col("total"))
    queues = kept(queues)
    sums = queues.agg(F.count(F.lit(1)).alias("queues"), F.sum("total").alias("tokens"), F.sum("share").alias("shares"),
                      F.min(F.when(F.col("share") > 0, F.col("share"))).alias("least"),
                      F.count(F.when(F.col("share") <= 0, 1)).alias("unweighted")).first()
    everything = sums["tokens"] or 0
    shares = Shares(sums["shares"] or 0, 1 if sums["least"] is None else sums["least"], sums["unweighted"], round_tokens)
    tail = everything % sequence_tokens
    last_full, tail_size = everything // sequence_tokens, 1 << max(0, (tail - 1).bit_length())

    def pieces(b: pa.RecordBatch, doc: np.ndarray, start: np.ndarray, end: np.ndarray, place: np.ndarray,
               token: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Cuts pieces that lie one after the other, as the ids of the batch do, at sequence borders."""
        head, tail_ = place // sequence_tokens, (place + end - start - 1) // sequence_tokens
        piece = np.repeat(np.arange(len(doc)), tail_ - head + 1)
        seq = ragged(head, tail_ - head + 1)
        lo = np.maximum(place[piece], seq * sequence_tokens)
        hi = np.minimum((place + end - start)[piece], (seq + 1) * sequence_tokens)
        doc, start, length = doc[piece], start[piece] + lo - place[piece], hi - lo
        ids = _ids(b).astype("<u4")
        n = np.asarray(b.column("n"))
        for at in range(0, len(doc), 1 << 16):              # a batch of bounded bytes
            part = slice(at, at + (1 << 16))
            base = int(length[:at].sum()) if at else 0
            ends = np.concatenate([[0], np.cumsum(length[part])])
            yield pa.record_batch({
                "doc_id": b.column("doc_id").take(pa.array(doc[part])),
                "source": b.column("queue").take(pa.array(doc[part])),
                "start": pa.array(start[part] - token[doc[part]]), "length": pa.array(length[part]),
                "doc_tokens": pa.array(n[doc[part]]), "sequence_id": pa.array(seq[part]),
                "offset": pa.array(lo[part] - seq[part] * sequence_tokens),
                "padded_to": pa.array(np.where(seq[part] < last_full, sequence_tokens, tail_size)),
                "ids": pa.Array.from_buffers(
                    pa.binary(), len(ends) - 1,
                    [None, pa.py_buffer((ends * 4).astype(np.int32)),
                     pa.py_buffer(ids[base:base + ends[-1]])])})

    schema = ("doc_id long, source string, start long, length long, doc_tokens long, "
              "sequence_id long, offset long, padded_to long, ids binary")
    rows = table.join(bases, ["chunk", "queue"])
    if sums["queues"] > max_queues:
        return _sorted(rows, queues, shares).mapInArrow(
            lambda batches: (out for b in batches if b.num_rows for out in pieces(
                b, np.arange(b.num_rows), np.asarray(b.column("start")), np.asarray(b.column("end")),
                np.asarray(b.column("place")), np.asarray(b.column("token")))), schema)
    held = queues.collect()                                         # max_queues rows at most
    plan = Schedule({r["queue"]: r["total"] for r in held}, {r["queue"]: shares.quantum(r["share"]) for r in held})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n = np.asarray(b.column("n"))
            token = np.asarray(b.column("base")) + np.asarray(b.column("before"))
            codes = b.column("queue").dictionary_encode()
            known = np.array([plan.index[q] for q in codes.dictionary.to_pylist()])
            queue = known[np.asarray(codes.indices)]
            doc, rounds, start, end = cut_at_rounds(token, n, plan.totals[queue], plan.quantum[queue])
            yield from pieces(b, doc, start, end, plan.position(queue[doc], rounds, start), token)

    return rows.select("doc_id", "queue", "before", "base", "n", "width", "ids").mapInArrow(run, schema)


def _ids(b: pa.RecordBatch) -> np.ndarray:
    """The ids of a batch, one row after the other."""
    return np.frombuffer(b"".join(b.column("ids").to_pylist()), f"<u{b.column('width')[0].as_py()}")


def _sorted(rows: DataFrame, queues: DataFrame, shares: Shares) -> DataFrame:
    """The pieces that rounds cut, with their ``place`` in the stream: the tokens of all pieces
    before them in the order of round, queue and token.  No task needs all queues."""
    def quanta(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"queue": b.column("queue"), "total": b.column("total"), "quantum": pa.array(
                [shares.quantum(x) for x in b.column("share").to_pylist()], pa.int64())})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n = np.asarray(b.column("n"))
            token = np.asarray(b.column("base")) + np.asarray(b.column("before"))
            doc, rounds, start, end = cut_at_rounds(token, n, np.asarray(b.column("total")), np.asarray(b.column("quantum")))
            ids, at = _ids(b), np.concatenate([[0], np.cumsum(end - start)])
            for i in range(0, len(doc), 1 << 16):
                part, few = slice(i, i + (1 << 16)), pa.array(doc[i:i + (1 << 16)])
                some = at[i:i + (1 << 16) + 1]
                yield pa.record_batch({
                    **{c: b.column(c).take(few) for c in ("doc_id", "queue", "n", "width")},
                    "token": pa.array(token[doc[part]]), "round": pa.array(rounds[part]), "start": pa.array(start[part]),
                    "end": pa.array(end[part]),
                    "ids": pa.Array.from_buffers(pa.binary(), len(some) - 1, [
                        None, pa.py_buffer(((some - some[0]) * ids.itemsize).astype(np.int32)),
                        pa.py_buffer(ids[some[0]:some[-1]])])})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            ends = seen + np.cumsum(np.asarray(b.column("end")) - np.asarray(b.column("start")))
            at = np.concatenate([[seen], ends])[:-1]
            seen = int(ends[-1]) if len(ends) else seen
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64()),
                                              pa.array(np.full(len(at), part, np.int32))],
                                             names=[*b.schema.names, "at", "part"])

    schedule = queues.mapInArrow(quanta, "queue string, total long, quantum long")
    made = ("doc_id long, queue string, n long, width int, token long, round long, start long, end long, ids binary")
    dealt = stored(rows.join(schedule, "queue").select("doc_id", "queue", "before", "base", "n", "width", "ids", "total", "quantum")
                   .mapInArrow(cut, made), "rounds")
    table = stored(dealt.repartitionByRange("round", "queue", "start").sortWithinPartitions("round", "queue", "start")
                   .mapInArrow(count, made + ", at long, part int"), "placed")
    first = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)          # a row a partition
    parts = table.groupBy("part").agg(F.sum(F.col("end") - F.col("start")).alias("held")).select(
        "part", F.coalesce(F.sum("held").over(first), F.lit(0)).alias("first"))
    return table.join(F.broadcast(parts), "part").withColumn("place", F.col("first") + F.col("at")).drop("part", "first", "at")
