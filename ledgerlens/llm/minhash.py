"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A text's set of word shingles gives a signature of 65 positions: the lowest 16 bits of the least
value of each of 65 hashes over the set.  Two sets agree in a position with a chance equal to
their Jaccard similarity, so their signature distance (positions that differ) is about
65 * (1 - similarity).

The join finds every pair of signatures at a distance of at most 25.  Signatures are split into
13 chunks of 5 positions: by pigeonhole two such signatures differ in at most one position of
some chunk.  The allowed errors are enumerated, so a signature is listed under 13 * 5 keys, each a
chunk with one position left out, and every such pair meets under a key.  At a similarity of 0.8
the distance is 13 on average and beyond 25 for one pair in about 7,000 (less for more similar
sets); links are confirmed on the full sets, so no false pair remains.

Work is on distinct sets.  Signatures that meet are linked by breadth-first walks that compare
unreached ones only, so a group of any size gives a forest and never all pairs; its components
under the distance are the groups within which full sets are compared, again by such walks.
Groups beyond a bounded size are cut into pieces, and each two pieces meet in a task of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import hot_join, kept, stored
from ledgerlens.llm.components import components

#: positions of a signature, bits of a position, positions of a chunk, errors allowed in a chunk
POSITIONS, BITS, CHUNK, ERRORS = 65, 16, 5, 1
CHUNKS = POSITIONS // CHUNK
#: the distance up to which the keys find every pair
DISTANCE = CHUNKS * (ERRORS + 1) - 1
SEED = 13
#: shingles hashed at a time
BLOCK = 1 << 13
#: signatures of one key that one task compares; a larger key is cut into blocks of this size
KEY_BLOCK = 20_000
#: signatures whose keys one task lists
SIGNATURES_PER_TASK = 8_000
#: sets and shingles of a group that one task compares, at most; a larger group is cut into pieces
PIECE_SETS, PIECE_SHINGLES = 1_000, 1 << 22
#: rows of a table of groups that is broadcast, at most (two numbers each)
BROADCAST_GROUPS = 500_000

_draw = np.random.default_rng(SEED)
_XOR = _draw.integers(0, 1 << 63, POSITIONS, dtype=np.uint64)
_TIMES = _draw.integers(0, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, width: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a text with A-Z lowered; of
    fewer words the whole sequence is one; empty without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    size = min(width, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - size + 1 + k])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The signature of a non-empty set of hashes."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        values = (shingles[at:at + BLOCK, None] ^ _XOR) * _TIMES
        np.minimum(least, values.min(axis=0), out=least)
    # the least value's high bits are small by choice: mix before taking bits
    return _mixed(least).astype(f"u{BITS // 8}")


def _prints(docs: DataFrame, width: int) -> DataFrame:
    """``(row, doc_id, text_key, n_shingles, set_key, signature)`` per row, stored; the row numbers
    are unique and stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), width) for t in batch.column(1)]
            keys = [xxhash.xxh3_128_digest(s.tobytes(), SEED) if len(s) else None for s in sets]
            signed = [signature(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(keys, pa.binary()), pa.array(signed, pa.binary())],
                ["doc_id", "text_key", "n_shingles", "set_key", "signature"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.xxhash64("text").alias("text_key"))
    found = rows.mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_key binary, signature binary")
    return stored(found.withColumn("row", F.monotonically_increasing_id()), "minhash-prints")


def _matrix(signatures: pa.Array) -> np.ndarray:
    joined = b"".join(signatures.to_pylist())
    return np.frombuffer(joined, f"<u{BITS // 8}").reshape(-1, POSITIONS)


def chunk_keys(signed: DataFrame) -> DataFrame:
    """``(key, id)``: the keys of ``signed(id, signature)``: every chunk with each choice of a
    position left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _matrix(batch.column(1)).astype(np.uint64)
            for chunk in range(CHUNKS):
                part = sig[:, chunk * CHUNK:(chunk + 1) * CHUNK]
                for left_out in range(CHUNK):
                    key = np.full(len(sig), chunk * CHUNK + left_out + 1, np.uint64)
                    for place in range(CHUNK):
                        if place != left_out:
                            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + part[:, place])
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)], ["key", "id"])

    return signed.mapInArrow(run, "key long, id long")


def _whole(batches: Iterator[pd.DataFrame], column: str) -> Iterator[pd.DataFrame]:
    """Frames in which no value of the sorted ``column`` is cut."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        values = batch[column].to_numpy()
        cut = int(np.flatnonzero(values != values[-1])[-1]) + 1 if values[0] != values[-1] else 0
        if rest and rest[-1][column].iloc[-1] != values[0]:
            yield pd.concat(rest)
            rest = []
        if cut:
            yield pd.concat([*rest, batch.iloc[:cut]])
            rest = []
        rest.append(batch.iloc[cut:])
    if rest:
        yield pd.concat(rest)


def _bounds(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


def _meetings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(meeting, id)`` of the ids that share a task, named by who they are: ids that meet under
    several keys make one meeting."""
    for rows in _whole(batches, "task"):
        task, ids = rows["task"].to_numpy(), rows["id"].to_numpy()
        order = np.lexsort((ids, task))
        task, ids = task[order], ids[order]
        fresh = np.append(True, (task[1:] != task[:-1]) | (ids[1:] != ids[:-1]))
        task, ids = task[fresh], ids[fresh]
        at = _bounds(task)
        size = np.diff(at)
        # a sum of mixed ids, and their number
        names = _mixed(np.add.reduceat(_mixed(ids.view(np.uint64) + np.uint64(1)), at[:-1]) + size.astype(np.uint64))
        several = np.repeat(size > 1, size)
        yield pd.DataFrame({"meeting": np.repeat(names.view(np.int64), size)[several], "id": ids[several]})


def _walks(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[int], list[int]]:
    """``(first, other)`` of ``n`` things: each walk's other things with the first of it.  A step
    asks ``near(i, others)`` for unreached ones only."""
    left, a, b = np.arange(n), [], []
    while len(left) > 1:
        first, left = int(left[0]), left[1:]
        front = [first]
        while front and len(left):
            hit = near(front.pop(), left)
            if hit.any():
                got, left = left[hit].tolist(), left[~hit]
                a.extend([first] * len(got))
                b.extend(got)
                front.extend(got)
    return a, b


def _close(distance: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Links of each meeting's signatures at a distance of at most ``distance``: to the smallest
    of their walk."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole(batches, "meeting"):
            rows = rows.sort_values(["meeting", "id"])
            ids = rows["id"].to_numpy()
            sig = np.frombuffer(b"".join(rows["signature"]), f"<u{BITS // 8}").reshape(-1, POSITIONS)
            at = _bounds(rows["meeting"].to_numpy())
            size = np.diff(at)
            two = at[:-1][size == 2]
            two = two[(sig[two] != sig[two + 1]).sum(axis=1) <= distance]
            out = [(ids[two], ids[two + 1])]
            for k in np.flatnonzero(size > 2):
                some, who = sig[at[k]:at[k + 1]], ids[at[k]:at[k + 1]]
                a, b = _walks(len(some), lambda i, others: (some[others] != some[i]).sum(axis=1) <= distance)
                out.append((who[a], who[b]))
            yield pd.DataFrame({"a": np.concatenate([o[0] for o in out]), "b": np.concatenate([o[1] for o in out])})
    return run


def close_signatures(signed: DataFrame, distance: int = DISTANCE, key_block: int = KEY_BLOCK) -> DataFrame:
    """``(a, b)``: links between ``signed(id, signature)`` that join every two signatures which differ
    in at most ``distance`` (``DISTANCE`` at most) positions, directly or through further links."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"the keys find distances of 0 to {DISTANCE}")
    tasks = max(1, -(-signed.count() // SIGNATURES_PER_TASK))
    rows = chunk_keys(signed.repartition(tasks, "id"))
    count = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > key_block)
    hot = kept(count.select("key", F.ceil(F.col("n") / key_block).cast("long").alias("blocks")))
    tasks = rows.select(F.col("key").alias("task"), "id")
    if hot.limit(1).count():
        mine = F.pmod(F.xxhash64("id"), F.col("blocks"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        spread = (rows.join(hot, "key").withColumn("mine", mine).withColumn("other", other)
                  .select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("task"), "id"))
        tasks = rows.join(hot.select("key"), "key", "left_anti").select(F.col("key").alias("task"), "id").union(spread)
    met = (tasks.repartition("task").sortWithinPartitions("task").mapInPandas(_meetings, "meeting long, id long")
           .distinct().join(signed, "id"))
    return (met.select("meeting", "id", "signature").repartition("meeting").sortWithinPartitions("meeting")
            .mapInPandas(_close(distance), "a long, b long"))


def _small(stored_rows: DataFrame) -> DataFrame:
    """A stored table, for broadcast if it has few rows."""
    return F.broadcast(stored_rows) if stored_rows.count() <= BROADCAST_GROUPS else stored_rows


def groups(links: DataFrame) -> DataFrame:
    """``(id, root)`` of the ids in ``links(a, b)``, in which a b has few links: one root a component.

    A b with no links of its own as an a is tied to its smallest a and drops out; what remains is
    the graph of the a that share a b, which is small (or empty) where links are stars.
    """
    edges = kept(links.distinct())
    tied = edges.groupBy("b").agg(F.min("a").alias("label"), F.count(F.lit(1)).alias("n"))
    firsts = edges.select("a").distinct()
    shared = (edges.join(tied.where("n > 1"), "b").where("a <> label")
              .select(F.col("label").alias("a"), F.col("a").alias("b")))
    chained = tied.join(firsts, F.col("b") == F.col("a"), "left_semi").select(F.col("label").alias("a"), "b")
    rest = kept(shared.union(chained).distinct())
    alone = firsts.join(tied, F.col("a") == F.col("b"), "left_anti").select(F.col("a").alias("id"), F.col("a").alias("root"))
    named = tied.select(F.col("b").alias("id"), F.col("label").alias("root")).union(alone)
    if not rest.limit(1).count():
        return named
    joined = _small(kept(components(rest)).select(F.col("id").alias("root"), F.col("root").alias("last")))
    return named.join(joined, "root", "left").select("id", F.coalesce("last", "root").alias("root"))


def _similar(percent: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Links of each task's sets by 100 * intersection >= percent * union: to the smallest of
    their walk."""
    def links(ids: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(ids)
        ids, sets = ids[order], [sets[i] for i in order]
        size = np.array([len(s) for s in sets])

        def near(i: int, others: np.ndarray) -> np.ndarray:
            hit = np.zeros(len(others), bool)
            fits = np.flatnonzero((100 * np.minimum(size[others], size[i])) >= percent * np.maximum(size[others], size[i]))
            if len(fits):
                some = [sets[j] for j in others[fits]]
                flat = np.concatenate(some)
                place = np.minimum(np.searchsorted(sets[i], flat), size[i] - 1)
                starts = np.cumsum([0, *map(len, some[:-1])])
                both = np.add.reduceat((sets[i][place] == flat).astype(np.int64), starts)
                hit[fits] = 100 * both >= percent * (size[i] + size[others[fits]] - both)
            return hit

        a, b = _walks(len(sets), near)
        return ids[a], ids[b]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole(batches, "task"):
            ids, sets = rows["id"].to_numpy(), [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
            at = _bounds(rows["task"].to_numpy())
            out = [links(ids[i:j], sets[i:j]) for i, j in zip(at[:-1], at[1:]) if j - i > 1]
            if out:
                yield pd.DataFrame({"a": np.concatenate([o[0] for o in out]), "b": np.concatenate([o[1] for o in out])})
    return run


def _sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """``(id, ..., shingles)``: the full sets of ``members(id, doc_id, text_key, ...)``, one a member."""
    extra = [c for c in members.columns if c not in ("doc_id", "text_key")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles = [shingle_set(t.as_py(), width).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(shingles, pa.binary())], [*extra, "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.xxhash64("text").alias("text_key"))
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.text_key") == F.col("m.text_key"))
    # rows that repeat one id and text are as good as each other: one of them stays
    texts = (rows.alias("d").join(members.alias("m"), same).select("d.text", *[f"m.{c}" for c in extra])
             .dropDuplicates(["id"]))
    types = ", ".join(f"{c} {dict(members.dtypes)[c]}" for c in extra)
    return texts.mapInArrow(run, f"{types}, shingles binary")


def confirmed(docs: DataFrame, members: DataFrame, percent: int = 80, width: int = 2, piece_sets: int = PIECE_SETS,
              piece_shingles: int = PIECE_SHINGLES) -> DataFrame:
    """``(a, b)``: links between ``members(id, root, doc_id, text_key, n_shingles)`` of one root that
    join every two whose full sets are similar, directly or through further links."""
    pieces = F.greatest(F.ceil(F.count(F.lit(1)) / piece_sets), F.ceil(F.sum("n_shingles") / piece_shingles))
    sizes = members.groupBy("root").agg(F.least(pieces, F.count(F.lit(1))).cast("long").alias("pieces"))
    large = _small(kept(sizes.where("pieces > 1")))
    placed = members.join(large, "root", "left").select(
        "id", "root", F.coalesce("pieces", F.lit(1).cast("long")).alias("pieces"), "doc_id", "text_key")
    sets = _sets(docs, placed, width)
    mine, low = F.pmod(F.xxhash64("id"), F.col("pieces")), F.lit(0).cast("long")
    # a lone piece is one task; of several, each two meet
    other = F.explode(F.when(F.col("pieces") > 1, F.sequence(low, F.col("pieces") - 1)).otherwise(F.array(low)))
    rows = (sets.withColumn("mine", mine).withColumn("other", other)
            .select(F.xxhash64("root", F.least("mine", "other"), F.greatest("mine", "other")).alias("task"), "id", "shingles"))
    return (rows.repartition("task").sortWithinPartitions("task").mapInPandas(_similar(percent), "a long, b long"))


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 2, key_block: int = KEY_BLOCK,
                    piece_sets: int = PIECE_SETS) -> DataFrame:
    """``(doc_id, text_key, n_shingles, component_id, kept)`` of every row of ``docs(doc_id, text)``.

    Words are runs without ASCII white space of the whole text with A-Z lowered; a set holds the
    distinct shingles of ``width`` words (of fewer words the whole sequence, of none it is empty).
    Rows are linked if 100 * intersection >= percent * union; ``component_id`` is the smallest
    doc_id that links reach, a row's own included, and the row whose id that is is ``kept``.
    ``text_key`` is a 64-bit hash of the text.

    Null, empty and wordless texts have an empty set, are linked with nothing and kept.  Equal sets
    always share a component; a null doc_id keeps its row and takes the smallest known id of its
    component (null, and then kept, if there is none); repeated rows stay repeated; further columns of ``docs``
    are ignored; an empty table gives an empty result.  Similarities below about 0.75 are found
    less surely, as the signature distance grows with 1 - similarity.
    """
    prints = _prints(docs, width)
    filled = prints.where("set_key is not null")
    classes = stored(filled.groupBy("set_key").agg(
        F.min("row").alias("id"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "minhash-classes")
    first = stored(filled.join(classes.select("id"), F.col("row") == F.col("id"), "left_semi").select(
        F.col("row").alias("id"), "doc_id", "text_key", "n_shingles", "signature"), "minhash-first")
    near = groups(close_signatures(first.select("id", "signature"), key_block=key_block))
    members = kept(near.join(first.drop("signature"), "id"))
    joined = kept(groups(confirmed(docs, members, percent, width, piece_sets)).join(classes.select("id", "least"), "id"))
    smallest = joined.groupBy("root").agg(F.min("least").alias("smallest"), F.count(F.lit(1)).alias("of"))
    placed = hot_join(joined.select("id", "root"), smallest, "root", "of").select("id", "smallest")
    named = classes.join(placed, "id", "left").select(
        "set_key", F.coalesce("smallest", "least").alias("component_id"), "copies")
    rows = prints.select("doc_id", "text_key", "n_shingles", "set_key")
    found = hot_join(rows.where("set_key is not null"), named, "set_key", "copies").select(
        "doc_id", "text_key", "n_shingles", "component_id")
    bare = rows.where("set_key is null").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.union(bare).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: DuckDB SQL of the registered query: sets joined on shared shingles, links closed by recursion
SQL = """
with recursive words as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) as w from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) = 1 then w else list_transform(range(1, len(w)),
           lambda i: w[i] || ' ' || w[i + 1]) end) as s from words),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (
  select x.doc_id as a, y.doc_id as b, count(*) as k
  from shingles x join shingles y on x.s = y.s and x.doc_id < y.doc_id group by x.doc_id, y.doc_id),
links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * k >= 80 * (x.n + y.n - k)),
pairs as (select a, b from links union select b, a from links),
reach as (select a, b from pairs union select r.a, l.b from reach r join pairs l on r.b = l.a),
ends as (select a as doc_id, min(b) as low from reach group by a)
select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles,
       least(doc_id, coalesce(low, doc_id)) as component_id,
       doc_id = least(doc_id, coalesce(low, doc_id)) as kept
from words left join sizes using (doc_id) left join ends using (doc_id)
"""
