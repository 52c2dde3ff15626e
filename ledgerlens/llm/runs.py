"""Periodic runs in the word sequences of whole texts, by online dyadic square catching.

A square is a stretch of words followed at once by its copy; its period is the copy's distance.
Words are appended in order, and whenever 2^k of them complete an aligned block, a catcher is
set up for it.  The catcher watches for its block coming back at the distances 2^(k+1)-1 to
2^(k+2)-2: every square with such a period holds a whole block of that size in its first half,
so some catcher sees the copy.  A sighting opens a suffix comparison of the words with those a
distance earlier, which runs back from the block and on with every further word until two differ.
If it reaches over a whole period, squares have ended at all those words, and they merge into one
run.  Sightings by consecutive blocks at one distance belong to one comparison, and a sighting
inside a known run at a multiple of its period can find nothing new.

Blocks are compared by 64-bit names, built for size 2^k from two names of size 2^(k-1); names
only open comparisons, which look at the words themselves, so no run rests on a hash.  The
catchers of one size, of all documents of a batch, take their steps together on arrays: a size
costs a few operations a word, and there are log2(words / exponent) sizes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: words that are looked at together (a longer document is a group of its own)
GROUP_WORDS = 1 << 20
#: (block, distance) cells compared at a time
CELLS = 1 << 20
#: steps of a comparison that are taken on arrays before the few that go on take larger ones
SHORT = 16
#: runs of so many words are kept at hand to pass over sightings inside them
LONG = 256

NONE = np.zeros(0, np.int64)


def _longer_names(names: np.ndarray, size: int) -> np.ndarray:
    """Names of all stretches of ``2 * size`` words from those of ``size`` words."""
    a, b = names[:-size], names[size:]
    mixed = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def _steps(words: np.ndarray, at: np.ndarray, period: np.ndarray, by: int) -> np.ndarray:
    """Words, up to ``SHORT``, over which each comparison goes on from ``at`` in steps of ``by``."""
    done = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    for step in range(SHORT):
        here = at[live] + by * step
        inside = (here >= 0) & (here + period[live] < len(words))
        live, here = live[inside], here[inside]
        live = live[words[here] == words[here + period[live]]]
        if not len(live):
            break
        done[live] += 1
    return done


def _agreement(words: np.ndarray, at: int, period: int, by: int) -> int:
    """Words over which one comparison goes on from ``at`` in steps of ``by``, to its end."""
    done, piece = 0, 64
    while True:
        if by > 0:
            lo, hi = at + done, min(at + done + piece, len(words) - period)
        else:
            lo, hi = max(at - done - piece + 1, 0), at - done + 1
        if lo >= hi:
            return done
        differ = np.flatnonzero(words[lo:hi] != words[lo + period:hi + period])
        if len(differ):
            return done + int(differ[0] if by > 0 else hi - lo - 1 - differ[-1])
        done, piece = done + hi - lo, piece * 2


def _sightings(names: np.ndarray, blocks: np.ndarray, widest: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(block, distance)`` at which the catchers of one size see their block again; of
    consecutive blocks at one distance only the first.  ``widest`` bounds a block's distances."""
    distances = np.arange(2 * size - 1, 4 * size - 1)
    held = np.append(names, names.dtype.type(0))
    rows, cols = [], []
    each = max(1, CELLS // len(distances))
    for at in range(0, len(blocks), each):
        b, w = blocks[at:at + each], widest[at:at + each]
        there = np.minimum(b[:, None] + distances, len(names))
        seen = (held[there] == names[b][:, None]) & (there < len(names)) & (distances <= w[:, None])
        r, c = np.nonzero(seen)
        rows.append(r + at)
        cols.append(c)
    r, c = np.concatenate(rows), np.concatenate(cols)
    order = np.lexsort((r, c))
    r, c = r[order], c[order]
    follows = np.zeros(len(r), bool)
    follows[1:] = (c[1:] == c[:-1]) & (r[1:] == r[:-1] + 1) & (blocks[r[1:]] == blocks[r[:-1]] + size)
    return blocks[r[~follows]], distances[c[~follows]]


def _merge(words: np.ndarray, block: np.ndarray, period: np.ndarray, size: int,
           known: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, length, period)`` of the runs that the sightings' comparisons make out; ``known``
    holds the long runs found so far as (start, end, period)."""
    ahead, back = _steps(words, block, period, 1), _steps(words, block - 1, period, -1)
    keep = np.ones(len(block), bool)
    for i in np.flatnonzero((ahead == SHORT) | (back == SHORT)):
        s, p = int(block[i]), int(period[i])
        if any(a <= s and s + p + size <= e and p % q == 0 for a, e, q in known):
            keep[i] = False
            continue
        if ahead[i] == SHORT:
            ahead[i] = _agreement(words, s, p, 1)
        if back[i] == SHORT:
            back[i] = _agreement(words, s - 1, p, -1)
        if ahead[i] + back[i] >= p and ahead[i] + back[i] + p >= LONG:
            known.append((s - int(back[i]), s + int(ahead[i]) + p, p))
    keep &= ahead + back >= period                                   # a square at least
    return (block - back)[keep], (ahead + back + period)[keep], period[keep]


def find_runs(words: np.ndarray, first: np.ndarray, count: np.ndarray, min_length: int = 6,
              min_exponent: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, length, period)`` of all runs of at least ``max(min_length, min_exponent *
    period)`` words (exponent 2 at least) in several documents, by start and period.

    ``words`` holds word numbers; document i takes ``count[i]`` places from ``first[i]``, and
    after each document stands a number that occurs nowhere else.  Documents stand in falling
    order of ``count``; starts are places in ``words``.
    """
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")
    found, known = [], []
    names, size = words.astype(np.uint64), 1
    while True:
        least = max(min_length, min_exponent * (2 * size - 1))
        active = int(np.searchsorted(-count, -least, side="right"))
        if not active:
            break
        names = names[:first[active - 1] + count[active - 1] + 2 - size]
        blocks = count[:active] // size
        of = np.repeat(np.arange(active), blocks)
        place = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        b, p = _sightings(names, first[of] + place * size, count[of] // min_exponent, size)
        if len(b):
            found.append(_merge(words, b, p, size, known))
        if len(names) <= 2 * size:
            break
        names, size = _longer_names(names, size), size * 2
    if not found:
        return NONE, NONE, NONE
    start, length, period = (np.concatenate(x) for x in zip(*found))
    # a run is seen again at multiples of its period: the smallest stands for its extent
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    fresh &= length >= np.maximum(min_length, min_exponent * period)
    start, length, period = start[fresh], length[fresh], period[fresh]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def text_words(text: str | None) -> list[bytes]:
    """Runs without ASCII white space of a text."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _group(docs: list[list[bytes]], min_length: int, min_exponent: int) -> tuple[np.ndarray, ...]:
    """Runs of several documents: ``(document, start in it, length, period)``, by document, start
    and period."""
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    count = np.array([len(docs[i]) for i in order], np.int64)
    first = np.cumsum(count + 1) - count - 1
    flat = pa.array([w for i in order for w in docs[i]], pa.binary()).dictionary_encode()
    words = np.empty(int(count.sum()) + len(docs), np.int64)
    ends = first + count
    inside = np.ones(len(words), bool)
    inside[ends] = False
    words[inside] = flat.indices.to_numpy()
    words[ends] = len(flat.dictionary) + np.arange(len(docs))
    start, length, period = find_runs(words, first, count, min_length, min_exponent)
    place = np.searchsorted(first, start, side="right") - 1
    doc = np.array(order, np.int64)[place]
    by_doc = np.argsort(doc, kind="stable")
    return doc[by_doc], (start - first[place])[by_doc], length[by_doc], period[by_doc]


def _collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not len(start):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    held = np.cumsum(edge)[:-1]
    return b" ".join([w for w, h in zip(words, held.tolist()) if not h])


def periodic_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4,
                  rewrite: Callable[[int, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` of every row of ``docs(doc_id, text)``.

    Words are runs without ASCII white space of the whole text, numbered from 0.  ``runs`` lists
    the maximal stretches of smallest period q and at least ``max(min_length, min_exponent * q)``
    words as (start, length, period) by start and period; ``collapsed`` is the text without the
    words that a run holds after its first q, words joined by one space.  ``rewrite`` may plant
    runs: given a document's id and number of words (1 at least) it returns None or (a, p), and
    then every word i >= a is replaced by word a + (i - a) % p first.

    Each row is worked on by itself (no shuffle), so repeated rows stay repeated and equal texts
    get equal runs.  Null, empty and wordless texts have no runs and an empty ``collapsed``; a
    null doc_id is kept and never rewritten; further columns of ``docs`` are ignored; an empty
    table gives an empty result.
    """
    fields = ["start", "length", "period"]
    run_type = pa.struct([(f, pa.int64()) for f in fields])

    def rows(ids: list, texts: list) -> pa.RecordBatch:
        words = []
        for i, text in zip(ids, texts):
            w = text_words(text)
            change = rewrite(i, len(w)) if rewrite and w and i is not None else None
            if change:
                a, p = change
                w = w[:a] + [w[a + (j - a) % p] for j in range(a, len(w))]
            words.append(w)
        doc, *found = _group(words, min_length, min_exponent)
        bounds = np.searchsorted(doc, np.arange(len(ids) + 1))
        listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()),
                                          pa.StructArray.from_arrays([pa.array(x) for x in found], fields))
        texts = [_collapsed(w, *(x[bounds[k]:bounds[k + 1]] for x in found)) for k, w in enumerate(words)]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int64()),
             listed.cast(pa.list_(run_type)), pa.array(texts, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                more = len(text) // 4 if text else 0                 # about the words of the text
                if ids and size + more > GROUP_WORDS:
                    yield rows(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(text)
                size += more
            if ids:
                yield rows(ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """``(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)`` of
    the result of :func:`periodic_runs`: the longest run (ties: smallest start, then period) and
    digests of the list of runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                                                      r["period"].cast("string")))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = found.withColumn("best", longest)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


#: DuckDB SQL of the digests with the planted rewriting of the registered query: every pair of equal
#: words at every distance, and stretches of consecutive pairs at one distance
SQL = """
with base as (
  select row_number() over () as rid, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) as w,
         xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, strlen(doc_id::varchar)),
               lambda k: ascii(substr(doc_id::varchar, k + 1, 1))::bigint)),
             lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
               lambda x, z: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295) as h
  from documents),
cut as (
  select rid, doc_id, w, len(w) as n, h % 10 = 0 and len(w) > 0 as planted, (h // 10) % greatest(len(w), 1) as a,
         1 + (len(w) - (h // 10) % greatest(len(w), 1)) // (3 + (h // 10) % 8) as p
  from base),
words as (
  select rid, i, w[1 + case when planted and i >= a then a + (i - a) % p else i end] as word
  from (select *, unnest(range(0, n)) as i from cut)),
pairs as (
  select x.rid, x.i, y.i - x.i as q
  from words x join words y on x.rid = y.rid and x.word = y.word and y.i > x.i
  join cut c on c.rid = x.rid and 4 * (y.i - x.i) <= c.n),
stretches as (
  select rid, q, min(i) as start, count(*) + q as length
  from (select *, i - row_number() over (partition by rid, q order by i) as island from pairs)
  group by rid, q, island having count(*) + q >= greatest(6, 4 * q)),
runs as (select rid, start, length, min(q) as period from stretches group by rid, start, length),
ranked as (
  select *, row_number() over (partition by rid order by length desc, start, period) as place from runs),
per as (
  select rid, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as listed,
         max(case when place = 1 then start end) as start, max(case when place = 1 then length end) as length,
         max(case when place = 1 then period end) as period
  from ranked group by rid),
left_over as (
  select x.rid, string_agg(x.word, ' ' order by x.i) as text
  from words x where not exists (
    select 1 from runs r where r.rid = x.rid and x.i >= r.start + r.period and x.i < r.start + r.length)
  group by x.rid)
select c.doc_id, cast(coalesce(n_runs, 0) as bigint) as n_runs, cast(start as bigint) as start,
       cast(length as bigint) as length, cast(period as bigint) as period,
       cast(1000 * length // period as bigint) as exponent_milli,
       sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(text, '')) as collapsed_sha256
from cut c left join per using (rid) left join left_over using (rid)
"""
