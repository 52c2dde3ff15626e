"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every window of ten words the smallest of its six 5-gram hashes is kept as a fingerprint, with
the words around it that windows holding it can reach.  Equal windows keep equal fingerprints, so
every shared span of ten words or more meets in the join of document and item fingerprints.  A
joined hit is extended word by word to both sides; where ten words or more agree, all of them lie
in occurring windows.  Items of fewer than ten words are one window each, winnowed in the same way
at their own length.

Every document is cut into words once for all lengths, and only its fingerprint hashes meet those
of the items; places and surroundings are made for the documents that share a hash.  Item fingerprints with equal
surroundings are one row, however many items and places have them, so a repeated word or line
costs in proportion to the document.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import kept

#: a word of the lowered text: ASCII digits, a-z and anything beyond ASCII
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: the same words before A-Z are lowered
WORD_ANY_CASE = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: words of a window and of a fingerprinted k-gram
WINDOW, GRAM = 10, 5
#: item fingerprints, and hit documents, are broadcast up to so many rows and characters; beyond, shuffled
BROADCAST_ROWS, BROADCAST_CHARS = 200_000, 1 << 25


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, all other characters as they are."""
    exact = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(text.rlike(r"[^\x00-\x7F]"), exact).otherwise(F.lower(text))


def _words(text: str = "text") -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def _prints(words: Column, windows: list[int]) -> Column:
    """The fingerprints of ``words`` for each window size, as an array of structs: ``size``, ``h``
    (hash of the k-gram), ``place``, ``around`` (the words of all windows that hold the k-gram) and
    ``lead`` (those of them before it).

    A k-gram is chosen if it has the smallest hash of some window that holds it.
    """
    found = []
    for k in sorted({min(GRAM, w) for w in windows}):
        sizes = [w for w in windows if min(GRAM, w) == k]
        found.append(_let(_grams(words, k), lambda grams: F.flatten(F.array(*[
            _chosen(words, grams, w, k) for w in sizes]))))
    return F.flatten(F.array(*found))


def _grams(words: Column, k: int) -> Column:
    """Hashes of all k-grams."""
    def hashed(each: Column) -> Column:
        # get() and not [], which fails past the end
        return F.transform(F.slice(each, 1, F.size(each) - k + 1),
                           lambda x, i: F.xxhash64(x, *[F.get(each, i + j) for j in range(1, k)]))

    none = F.array().cast("array<bigint>")
    return F.when(F.size(words) < k, none).otherwise(
        _let(F.transform(words, lambda w: F.xxhash64(w)), hashed))


def _least(grams: Column, window: int, k: int) -> Column:
    """The smallest k-gram hash of each window."""
    held = window - k + 1
    return F.transform(F.slice(grams, 1, F.greatest(F.size(grams) - held + 1, F.lit(0))),
                       lambda x, i: _of(F.least, [x, *[F.get(grams, i + j) for j in range(1, held)]]))


def _hashes(words: Column, windows: list[int]) -> Column:
    """The distinct hashes of the fingerprints of ``words``."""
    found = [_let(_grams(words, k), lambda grams: F.flatten(F.array(*[
        _least(grams, w, k) for w in windows if min(GRAM, w) == k])))
        for k in sorted({min(GRAM, w) for w in windows})]
    return F.array_distinct(F.flatten(F.array(*found)))


def _chosen(words: Column, grams: Column, window: int, k: int) -> Column:
    held = window - k + 1

    def struct(p: Column) -> Column:
        first = F.greatest(p - held + 1, F.lit(0))
        return F.struct(F.lit(window).alias("size"), F.get(grams, p).alias("h"), p.alias("place"),
                        F.slice(words, first + 1, p - first + window).alias("around"), (p - first).alias("lead"))

    def places(least: Column) -> Column:
        # no window's least hash is above a k-gram's that it holds: chosen if the greatest is its own
        # (get() is null, and left out, where no window begins)
        def smallest(x: Column, p: Column) -> Column:
            return F.when(_of(F.greatest, [F.get(least, p - j) for j in range(held)]) == x, p)

        return F.transform(F.filter(F.transform(grams, smallest), lambda p: p.isNotNull()), struct)

    return _let(_least(grams, window, k), places)


def _of(pick: Callable[..., Column], values: list[Column]) -> Column:
    """``least`` or ``greatest`` of one value or more."""
    return pick(*values) if len(values) > 1 else values[0]


def _agreeing(agree: Column) -> Column:
    """How many leading elements of an array of booleans are true."""
    return _let(agree, lambda a: F.when(F.array_position(a, F.lit(False)) == 0, F.size(a))
                .otherwise(F.array_position(a, F.lit(False)).cast("int") - 1))


def _extended() -> Column:
    """Of a joined hit the span of agreeing words, as an array of one or (too short) no struct."""
    ahead = F.transform(F.slice("i.around", F.col("i.lead") + 1, F.size("i.around")),
                        lambda x, j: F.coalesce(F.get("d.around", F.col("d.lead") + j) == x, F.lit(False)))
    behind = F.transform(F.reverse(F.slice("i.around", F.lit(1), F.col("i.lead"))),
                         lambda x, j: F.coalesce(F.get("d.around", F.col("d.lead") - j - 1) == x, F.lit(False)))
    sides = F.struct(_agreeing(behind).alias("left"), _agreeing(ahead).alias("right"))
    span = _let(sides, lambda s: F.struct(
        (F.col("d.place") - s["left"]).alias("start"), (F.col("d.place") + s["right"]).alias("stop"),
        ((s["right"] >= F.least(F.lit(GRAM), "i.size")) & (s["left"] + s["right"] >= F.col("i.size"))).alias("whole")))
    return F.filter(F.array(span), lambda s: s["whole"])


def _spans(docs: DataFrame, benchmark: DataFrame, window: int, broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, text_key, start, stop, class)`` and ``(class, item_id)``, both stored: the spans of
    document words (from 0, ``stop`` excluded) in occurring windows, and the items of each class of
    item fingerprints."""
    items = (benchmark.select("item_id", "text").where("text is not null").distinct()
             .select("item_id", _words().alias("words")).where("size(words) > 0"))
    items = kept(items.select("item_id", "words", F.least(F.size("words"), F.lit(window)).alias("window")))
    sizes = sorted(r["window"] for r in items.select("window").distinct().collect())   # `window` rows at most
    prints = (items.select("item_id", "window", F.explode(_prints(F.col("words"), sizes or [window])).alias("f"))
              .where("f.size = window").select("item_id", "f.size", "f.h", "f.lead", "f.around"))
    names = ["size", "h", "lead", "around"]
    classes = kept(prints.select(*names).distinct().withColumn("class", F.monotonically_increasing_id()))
    of = kept(prints.join(classes, names).select("class", "item_id").distinct())
    held = classes.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.concat_ws(" ", "around"))).alias("chars")).first()
    small = held["n"] <= broadcast_rows and (held["chars"] or 0) <= BROADCAST_CHARS
    sizes = sizes or [window]
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").where("text is not null")
    # documents that share a fingerprint with an item
    hashes = (texts.select("doc_id", "text_key", _words().alias("words"))
              .select("doc_id", "text_key", F.explode(_hashes(F.col("words"), sizes)).alias("h")))
    wanted = classes.select("h").distinct()
    keys = kept(hashes.join(F.broadcast(wanted) if small else wanted, "h", "left_semi")
                .select("doc_id", "text_key").distinct())
    near = F.broadcast(keys) if keys.count() <= broadcast_rows else keys
    same = F.col("t.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("t.text_key") == F.col("k.text_key"))
    rows = texts.alias("t").join(near.alias("k"), same, "left_semi")
    found = (rows.select("doc_id", "text_key", _words().alias("words"))
             .select("doc_id", "text_key", F.explode(_prints(F.col("words"), sizes)).alias("f"))
             .select("doc_id", "text_key", "f.*"))
    met = found.alias("d").join((F.broadcast(classes) if small else classes).alias("i"),
                                (F.col("d.size") == F.col("i.size")) & (F.col("d.h") == F.col("i.h")))
    spans = met.select("doc_id", "text_key", "class", F.explode(_extended()).alias("s"))
    return kept(spans.select("doc_id", "text_key", "s.start", "s.stop", "class").distinct()), of


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(doc_id, text_key, item_id, start, stop)``: for each distinct (doc_id, text) and item with
    an occurring window, the spans of the document's words (from 0, ``stop`` excluded) that agree
    with the item around a fingerprint; spans may overlap.

    ``text_key`` is a 64-bit hash of the text; with the doc_id it stands for the row.
    """
    spans, of = _spans(docs, benchmark, window, broadcast_rows)
    return spans.join(of, "class").select("doc_id", "text_key", "item_id", "start", "stop").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Every row of ``docs`` with ``n_words, n_hit, n_items, items_sha256, contaminated``.

    ``docs`` keeps its own columns (of clashing names, only ``doc_id`` and ``text`` are read and
    the new columns replace old ones).  A null text has no words; a null doc_id is an id like any
    other; repeated rows each get their row; an item without words, and an empty benchmark, hit
    nothing; repeated items count once; an item whose item_id is null hits words but is not
    listed.  Texts of any length are read whole.
    """
    spans, of = _spans(docs, benchmark, window, broadcast_rows)
    key = ["doc_id", "text_key"]
    # words of a span behind all that earlier spans reach
    earlier = Window.partitionBy(*key).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest("start", F.coalesce(F.max("stop").over(earlier), F.lit(0)))
    words = (spans.select(*key, "start", "stop").distinct()
             .withColumn("fresh", F.greatest(F.col("stop") - reached, F.lit(0)))
             .groupBy(*key).agg(F.sum("fresh").alias("hit_words")))
    named = (spans.select(*key, "class").distinct().join(of, "class")
             .select(*key, F.col("item_id").cast("string").alias("item_id")).distinct()
             .groupBy(*key).agg(F.sort_array(F.collect_list("item_id")).alias("ids")))
    same = F.col("w.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("w.text_key") == F.col("n.text_key"))
    hits = kept(words.alias("w").join(named.alias("n"), same).select(
        F.col("w.doc_id").alias("hit_id"), F.col("w.text_key").alias("hit_key"), "hit_words",
        F.size("ids").alias("hit_items"), F.sha2(F.concat_ws(",", "ids"), 256).alias("hit_sha256")))
    small = hits.count() <= broadcast_rows                             # some 100 bytes a row
    new = {
        "n_words": F.coalesce(F.regexp_count("row.text", F.lit(WORD_ANY_CASE)), F.lit(0)).cast("long"),
        "n_hit": F.coalesce("hit_words", F.lit(0)).cast("long"),
        "n_items": F.coalesce("hit_items", F.lit(0)).cast("long"),
        "items_sha256": F.coalesce("hit_sha256", F.sha2(F.lit(""), 256)),
        "contaminated": F.coalesce(F.col("hit_words") > 0, F.lit(False)),
    }
    rows = docs.drop(*new).select(F.struct("*").alias("row"))          # no name can clash
    match = F.col("row.doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64("row.text") == F.col("hit_key"))
    return (rows.join(F.broadcast(hits) if small else hits, match, "left")
            .select("row.*", *[c.alias(n) for n, c in new.items()]))


#: DuckDB SQL of the same result, by comparing every window
SQL = """
with docs as (
  select row_number() over () as rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from documents),
items as (
  select item_id, w, least(len(w), 10) as size from (
    select distinct item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
    from benchmark where text is not null)
  where len(w) > 0),
item_windows as (
  select distinct item_id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') as win
  from (select item_id, size, w, unnest(range(1, len(w) - size + 2)) as i from items)),
doc_windows as (
  select rid, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') as win
  from (select rid, w, size, unnest(range(1, len(w) - size + 2)) as i
        from docs, (select distinct size from items) where len(w) >= size)),
hits as (
  select rid, item_id, i, d.size from doc_windows d join item_windows x on d.size = x.size and d.win = x.win),
words as (
  select rid, count(distinct p) as n_hit
  from (select rid, unnest(range(i, i + size)) as p from hits) group by rid),
named as (
  select rid, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct rid, cast(item_id as varchar) as id from hits where item_id is not null) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from docs left join words using (rid) left join named using (rid)
"""
