"""SimHash near-duplicates: 64-bit fingerprints linked by Golay-code fuzzy keys.

A fingerprint is cut into three segments of at most 23 bits.  If two fingerprints differ in
at most 3 bits, the errors of some two segments are at most one each (pigeonhole), so for that
pair of segments the nearest codewords of one fingerprint are among the fuzzy keys of the
other (see ``golay``).  Every fingerprint is therefore listed under the codeword pairs of its
three segment pairs, and looks under all its key pairs (36 a pair of segments at most).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import golay
from ledgerlens.llm.common import hot_join, kept
from ledgerlens.llm.components import components

#: (lowest bit, bits) of the segments
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
SEED = 42
#: hashes summed at a time
BLOCK = 1 << 16
#: fingerprints of one key that one task compares; a larger key is cut into blocks of this
#: size, and every two blocks meet in a task of their own
KEY_BLOCK = 20_000
#: fingerprints whose keys one task lists
PRINTS_PER_TASK = 8_000


def text_fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text (0 if it has no word)."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[width - 1:] or ends[-1:]
    counts, n = np.zeros(64, np.int64), len(ends)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        h = np.array([digest(joined[s:e], SEED)
                      for s, e in zip(starts[at:at + BLOCK], ends[at:at + BLOCK])], dtype="<u8")
        # bit sums of 8 positions at a time, as byte lanes of one word, 255 hashes at most a sum
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, text_key, fp)``: the signed 64-bit fingerprint of every row's whole text, and a
    64-bit hash of the text that, with the doc_id, stands for the row.

    A null, empty or wordless text has fingerprint 0; repeated rows stay repeated.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([text_fingerprint(t, width) for t in b["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "text_key": b["text_key"],
                                "fp": fp.view(np.int64)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInPandas(run, "doc_id long, text_key long, fp long")


def _fuzzy_keys(fps: DataFrame) -> DataFrame:
    """``(key, fp, own)``: rows under which a fingerprint is listed (own) or looks."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy(np.int64)
            bits = fp.view(np.uint64)
            seg = [golay.keys((bits >> np.uint64(at)) & np.uint64((1 << n) - 1)) for at, n in SEGMENTS]
            for which, (i, j) in enumerate(PAIRS):
                for x in range(golay.KEYS):
                    for y in range(golay.KEYS):
                        a, c = seg[i][:, x], seg[j][:, y]
                        used = (a >= 0) & (c >= 0)
                        yield pd.DataFrame({"key": (which << 24 | a << 12 | c)[used].astype(np.int32),
                                            "fp": fp[used], "own": x == y == 0})

    return fps.mapInPandas(run, "key int, fp long, own boolean")


def _star(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of each fingerprint to the smallest of its cluster among ``fps`` (distinct): a
    breadth-first walk in which every step looks at unreached fingerprints only."""
    left, a, b = np.sort(fps), [], []
    while len(left) > 1:
        root, left, front = left[0], left[1:], [left[0]]
        while front and len(left):
            near = np.bitwise_count((left ^ front.pop()).view(np.uint64)) <= distance
            if near.any():
                got, left = left[near], left[~near]
                a.append(got)
                b.append(np.full(len(got), root))
                front.extend(got)
    none = np.zeros(0, np.int64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def _cluster(distance: int):
    """Verified star links of the fingerprints that meet under a key; rows come sorted by
    (key, block), and a key is carried over batch borders."""
    def links(keys: np.ndarray, fps: np.ndarray, own: np.ndarray) -> pd.DataFrame:
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        sizes = np.diff(bounds)
        out_a, out_b = [], []
        two = bounds[:-1][sizes == 2]
        near = np.bitwise_count((fps[two] ^ fps[two + 1]).view(np.uint64)) <= distance
        two = two[near & (own[two] | own[two + 1])]
        out_a.append(fps[two])
        out_b.append(fps[two + 1])
        for k in np.flatnonzero(sizes > 2):
            at, to = bounds[k], bounds[k + 1]
            if own[at:to].any():
                a, b = _star(np.unique(fps[at:to]), distance)
                out_a.append(a)
                out_b.append(b)
        return pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            rows = tuple(batch[c].to_numpy() for c in ("task", "fp", "own"))
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if cut:
                whole = [np.concatenate([*(r[i] for r in rest), rows[i][:cut]]) for i in range(3)]
                yield links(*whole)
                rest = []
            rest.append(tuple(r[cut:] for r in rows))
        if rest:
            yield links(*(np.concatenate([r[i] for r in rest]) for i in range(3)))
    return run


def links(fps: DataFrame, distance: int = 3, key_block: int = KEY_BLOCK) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints ``fps(fp)`` that join every two of them
    differing in at most ``distance`` (3 at most) bits, directly or through further links.

    Rows meet by key and are compared in key order.  A key under which more than ``key_block``
    fingerprints meet is cut into blocks by fingerprint hash, and each two blocks become a task
    key, so a group of any size is spread and no pair is lost.
    """
    if not 0 <= distance <= 3:
        raise ValueError("the keys find distances of 0 to 3")
    # the table is small but its keys are not: dealt out by number, not by bytes
    tasks = max(1, -(-fps.count() // PRINTS_PER_TASK))
    rows = _fuzzy_keys(fps.repartition(tasks, "fp"))
    # keys where somebody is listed and somebody else looks
    count = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("any"))
    hot = (count.where(F.col("any") & (F.col("n") > key_block))
           .select("key", F.ceil(F.col("n") / key_block).cast("int").alias("blocks")))
    hot = kept(hot)
    cold = rows.select(F.col("key").cast("long").alias("task"), "fp", "own")
    tasks = cold
    if hot.limit(1).count():
        block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("long")
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1))
        spread = (rows.join(hot, "key").withColumn("mine", block).withColumn("other", other)
                  .select((F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
                           .bitwiseOR(F.lit(-(1 << 63)))).alias("task"), "fp", "own"))
        tasks = (rows.join(hot.select("key"), "key", "left_anti")
                 .select(F.col("key").cast("long").alias("task"), "fp", "own").union(spread))
    return (tasks.repartition("task").sortWithinPartitions("task")
            .mapInPandas(_cluster(distance), "a long, b long"))


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3,
                    key_block: int = KEY_BLOCK) -> DataFrame:
    """``(doc_id, text_key, fp, fingerprint, component, component_id)`` of every row of
    ``docs(doc_id, text)``; ``component`` names the component by its smallest fingerprint.

    Words are runs without ASCII white space of the text with A-Z lowered; fingerprints that
    differ in at most ``distance`` bits are linked, and ``component_id`` is the smallest doc_id
    that links reach, a document's own included.  Null, empty and wordless texts have
    fingerprint 0 and are linked like any other; equal texts always share a component; a null
    doc_id keeps its row and takes the smallest known id of its component (null if none);
    repeated rows stay repeated; further columns of ``docs`` are ignored; an empty table gives
    an empty result.
    """
    prints = kept(fingerprints(docs, width))
    classes = kept(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    joined = components(links(classes.select("fp"), distance, key_block))
    roots = (classes.join(joined, F.col("fp") == F.col("id"), "left")
             .select("fp", "least", "copies", F.coalesce("root", "fp").alias("root")))
    smallest = roots.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("of"))
    named = hot_join(roots.select("fp", "copies", "root"), smallest, "root", "of").drop("of")
    # copies of one text, and empty texts, share a fingerprint
    return (hot_join(prints, named, "fp", "copies")
            .select("doc_id", "text_key", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                    F.col("root").alias("component"), "component_id"))
