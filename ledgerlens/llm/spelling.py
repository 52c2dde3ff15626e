"""Spelling variant grouping: words of the corpus that differ by one code point, by a bit-sliced
position index.

For a list of words the index holds, per position and letter, a bitset over the words that have
the letter there.  A word is looked up by running over its letters once and carrying four bitsets
over all words at the same time: those that agree so far without an error, and those that agree
after one letter was replaced (same positions), was put in (positions shifted by +1) or left out
(shifted by -1).  A letter costs a few AND / OR operations on machine words of 64 candidates.

Two words of m and m or m+1 letters that differ by one edit share their first m // 2 letters or
their last m - m // 2 ones, so the vocabulary is dealt into blocks by these halves (four rows a
word), and the index is built per block.  Words of a large block are cut into pieces of bounded
size; each piece is indexed in a task of its own, and every word of the block is looked up there.
A block gives per word the number of near words and the best of them; lists of pairs are never
written.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import kept, stored

#: letters of a word; only A-Z are lowered
LETTERS = "A-Za-zÀ-ÿ"
#: small blocks are indexed together up to so many words; looked-up words that run together
INDEX_WORDS = 512
LOOKUPS = 1024
#: words of one block that are indexed in a task; a larger block is cut into pieces of about this
#: size, and every piece is looked up in every other in a task of its own
PIECE_WORDS = 16_384
#: letters (words times the longest word) that a piece holds
PIECE_LETTERS = 1 << 22


def planted_slips(words: DataFrame) -> DataFrame:
    """``(word)`` of ``words(id, word)`` with a fixed misspelling of one in 31 of the (document,
    word) pairs: with h the unsigned crc32 of ``<id>:<word>`` (a null id is empty), the letter
    h % length (from 0) is left out if 31 divides h."""
    text = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), "word")
    hashed = words.select("word", F.crc32(text.cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("word")).cast("int")
    cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
    return hashed.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("word")).alias("word"))


def vocabulary(docs: DataFrame, min_letters: int = 7, min_count: int = 2, plant: bool = False) -> DataFrame:
    """``(word, n)``: the distinct words of at least ``min_letters`` letters that occur at least
    ``min_count`` times in all texts of ``docs(doc_id, text)``.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with only A-Z lowered; ``plant``
    applies :func:`planted_slips` to them.  A shorter run is never part of a word.
    """
    # a run of at least so many letters is matched whole, a shorter one not at all
    found = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{max(1, min_letters)},}}+"), F.lit(0))
    words = (docs.select(F.col("doc_id").alias("id"), F.explode(found).alias("word"))
             .select("id", F.translate("word", string.ascii_uppercase, string.ascii_lowercase).alias("word")))
    if plant:
        words = planted_slips(words)
    # the length as an aggregate: a filter on the word itself would move below and hash it again
    return (words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.max(F.char_length("word")).alias("letters"))
            .where((F.col("n") >= min_count) & (F.col("letters") >= min_letters)).select("word", "n"))


def _blocks(words: DataFrame, shortest: int) -> DataFrame:
    """``(block, word, n)``: the blocks by halves in which a word meets its near words.

    A block is named by the letters m of the shorter word (``shortest`` at least), the half and
    its letters.
    """
    size = F.char_length("word")
    m = F.explode(F.array(size, size - 1)).alias("m")
    rows = words.select("word", "n", m).where(F.col("m") >= max(1, shortest))
    half = F.floor(F.col("m") / 2).cast("int")
    first = F.concat("m", F.lit("<"), F.left("word", half))
    last = F.concat("m", F.lit(">"), F.right("word", F.col("m") - half))
    return rows.select(F.explode(F.array(first, last)).alias("block"), "word", "n")


def _letters(words: list[str]) -> np.ndarray:
    """Letters of words as a matrix of code points, 0 beyond a word's end."""
    longest = max(map(len, words))
    return np.array(words, f"<U{longest}").view("<u4").reshape(len(words), longest).astype(np.uint16)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as bitsets of 64-bit words."""
    out = np.zeros((*bits.shape[:-1], -(-bits.shape[-1] // 64) * 8), np.uint8)
    out[..., :-(-bits.shape[-1] // 8)] = np.packbits(bits, axis=-1, bitorder="little")
    return out.view(np.uint64)


class PositionIndex:
    """Bitsets per position and letter over a list of words."""

    def __init__(self, words: list[str]):
        self.letters = _letters(words)
        self.sizes = np.count_nonzero(self.letters, axis=1)
        self.nobody = _packed(np.zeros(len(words), bool))
        self._sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._of_size: dict[int, np.ndarray] = {}

    def sets(self, position: int, letters: np.ndarray) -> np.ndarray:
        """For each of ``letters`` the bitset of the words that have it at ``position``."""
        if not 0 <= position < self.letters.shape[1]:
            return np.broadcast_to(self.nobody, (len(letters), len(self.nobody)))
        if position not in self._sets:
            column = self.letters[:, position]
            known = np.unique(column[column > 0])
            # behind the known letters a row for all others
            rows = np.vstack([_packed(column == known[:, None]), self.nobody[None, :]])
            self._sets[position] = np.append(known, np.uint16(0)), rows
        known, rows = self._sets[position]
        at = np.searchsorted(known[:-1], letters)
        at[known[at] != letters] = len(known) - 1
        return rows[at]

    def of_size(self, size: int) -> np.ndarray:
        """The bitset of the words of ``size`` letters."""
        if size not in self._of_size:
            self._of_size[size] = _packed(self.sizes == size)
        return self._of_size[size]

    def near(self, words: np.ndarray, among: np.ndarray, m: int, half: int, suffix: bool) -> np.ndarray:
        """Per looked-up word (a row of code points, all words of one length, m or m + 1) the
        bitset of the index's words in ``among`` at exactly one edit, of which the shorter of the
        two has ``m`` letters.

        In a prefix block all words share their first ``half`` letters, and the run begins behind
        them.  In a suffix block they share what follows the first ``half`` letters of the shorter
        word, so it ends there; words that agree with no error until then are left out: they share
        a prefix block.
        """
        size = words.shape[1]
        zero, none = among, np.zeros_like(among)
        same, put_in, left_out, early = none, none, none, none
        for i in range(0 if suffix else half, half + size - m if suffix else size):
            if suffix and i == half:
                early = zero
            letter = words[:, i]
            here = self.sets(i, letter)
            # a letter replaced: positions agree; put in: the other word is one ahead; left out: one behind
            same = (same & here) | (zero & ~here)
            put_in = (put_in | zero) & self.sets(i + 1, letter)
            left_out = (left_out & self.sets(i - 1, letter)) | zero
            zero = zero & here
        if suffix and size == m:
            early = zero
        if size == m:
            if not suffix:
                put_in = put_in | zero                     # a letter put in behind the last one
            near = (same & self.of_size(m)) | (put_in & self.of_size(m + 1))
        else:
            near = left_out & self.of_size(m)
        return near & among & ~early


def _ranges(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Bitsets over ``n`` places with those from ``lo`` to before ``hi`` set."""
    base = np.arange(-(-n // 64)) * 64

    def below(end: np.ndarray) -> np.ndarray:
        k = np.clip(end[:, None] - base, 0, 64).astype(np.uint64)
        # all ones above 63, as a shift by 64 is none
        return np.where(k > 63, ~np.uint64(0), (np.uint64(1) << (k & np.uint64(63))) - np.uint64(1))

    return below(hi) & ~below(lo)


def _members(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, place)`` of the set bits of bitsets, by row."""
    row, word = np.nonzero(sets)
    hit, bit = np.nonzero(np.unpackbits(sets[row, word][:, None].view(np.uint8), axis=1, bitorder="little"))
    return row[hit], word[hit] * 64 + bit


def _frame(parts: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
    """Found rows as a frame whose words are plain objects (text columns of pandas may come in
    several chunks, which Spark doesn't take)."""
    names, kinds = ("word", "n_near", "best_n", "best"), (object, np.int64, np.int64, object)
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [[]] * 4
    return pd.DataFrame({n: pd.Series(c, dtype=k) for n, c, k in zip(names, columns, kinds)})


def _look_up(task: np.ndarray, words: np.ndarray, counts: np.ndarray, own: np.ndarray, asks: np.ndarray) -> pd.DataFrame:
    """``(word, n_near, best_n, best)`` of the asking rows that have near words among the ``own``
    rows of their task; rows of a task stand together."""
    new = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
    of = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(task))))
    held = np.flatnonzero(own)
    bounds = np.searchsorted(of[held], np.arange(len(new) + 1))
    # a word alone in its task has nothing near
    others = np.diff(bounds)[of] - own
    asking = np.flatnonzero(asks & (others > 0))
    if not len(asking):
        return _frame([])
    index, held_n = PositionIndex(words[held].tolist()), counts[held]
    order = np.empty(len(held), np.int64)
    order[np.argsort(words[held], kind="stable")] = np.arange(len(held))     # code-point order
    suffix = np.array([">" in t for t in task[new]])
    m = np.array([int(t[:t.index(">" if s else "<")]) for t, s in zip(task[new], suffix)])
    size = np.fromiter(map(len, words[asking]), np.int64, len(asking))
    kinds = np.stack([m[of[asking]], suffix[of[asking]], size])
    by_kind = np.lexsort(kinds)
    cuts = np.flatnonzero((np.diff(kinds[:, by_kind]) != 0).any(axis=0)) + 1
    out = []
    for part in np.split(by_kind, cuts):
        shorter, behind = int(kinds[0, part[0]]), bool(kinds[1, part[0]])
        for at in range(0, len(part), LOOKUPS):
            chosen = asking[part[at:at + LOOKUPS]]
            among = _ranges(bounds[of[chosen]], bounds[of[chosen] + 1], len(held))
            near = index.near(_letters(words[chosen].tolist()), among, shorter, shorter // 2, behind)
            q, w = _members(near)
            first = np.lexsort((order[w], -held_n[w], q))
            first = first[np.flatnonzero(np.diff(q[first], prepend=-1))]
            out.append((words[chosen[q[first]]], np.bincount(q)[q[first]], held_n[w[first]], words[held[w[first]]]))
    return _frame(out)


def _looked_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Looks words up batch by batch; small tasks run together, a task is never cut."""
    rest: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        at = 0
        task = batch["task"].to_numpy()
        ends = np.append(np.flatnonzero(task[1:] != task[:-1]) + 1, len(task)) if len(task) else []
        if len(task) and rest and rest[-1]["task"].iloc[-1] != task[0] and size >= INDEX_WORDS:
            yield _look_up(*(np.concatenate([r[c].to_numpy() for r in rest]) for c in COLUMNS))
            rest, size = [], 0
        for end in ends:
            # the last task of a batch may go on in the next one
            if size + end - at >= INDEX_WORDS and end < len(task):
                rest.append(batch.iloc[at:end])
                yield _look_up(*(np.concatenate([r[c].to_numpy() for r in rest]) for c in COLUMNS))
                rest, size, at = [], 0, end
        if at < len(task):
            rest.append(batch.iloc[at:])
            size += len(task) - at
    if rest:
        yield _look_up(*(np.concatenate([r[c].to_numpy() for r in rest]) for c in COLUMNS))


COLUMNS = ("task", "word", "n", "own", "asks")


def near_words(words: DataFrame, shortest: int = 1, piece_words: int = PIECE_WORDS,
               piece_letters: int = PIECE_LETTERS) -> DataFrame:
    """``(word, n_near, best_n, best)`` of the words of ``words(word, n)`` (distinct, of at least
    ``shortest`` letters) that differ from
    another one by exactly one inserted, deleted or replaced code point: how many those are, and
    the most frequent of them (ties: first in code-point order) with its ``n``."""
    rows = _blocks(words, shortest)
    letters = F.element_at(F.split("block", "[<>]", 2), 1).cast("long")
    count = rows.groupBy("block").agg(F.count(F.lit(1)).alias("held"))
    pieces = F.greatest(F.ceil(F.col("held") / piece_words), F.ceil(F.col("held") * letters / piece_letters))
    pieces = F.least(pieces, F.col("held")).cast("long")
    hot = kept(count.select("block", pieces.alias("pieces")).where("pieces > 1"))
    cold = rows.select(F.col("block").alias("task"), "word", "n", F.lit(True).alias("own"), F.lit(True).alias("asks"))
    tasks = cold
    if hot.limit(1).count():
        spread = rows.join(hot, "block").withColumn("mine", F.pmod(F.xxhash64("word"), "pieces"))
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("other")
        spread = spread.select("block", "word", "n", "mine", each)
        # a piece is indexed for every piece that is looked up in it
        def side(held: str, asked: str, own: bool, asks: bool) -> Column:
            return F.struct(F.col(held).alias("held"), F.col(asked).alias("asked"), F.lit(own).alias("own"),
                            F.lit(asks).alias("asks"))

        sides = F.when(F.col("mine") == F.col("other"), F.array(side("mine", "mine", True, True))).otherwise(
            F.array(side("mine", "other", True, False), side("other", "mine", False, True)))
        spread = spread.select("block", "word", "n", F.inline(sides)).select(
            F.concat_ws(" ", "block", "held", "asked").alias("task"), "word", "n", "own", "asks")
        tasks = cold.join(hot.select(F.col("block").alias("task")), "task", "left_anti").union(spread)
    found = (tasks.repartition("task").sortWithinPartitions("task")
             .mapInPandas(_looked_up, "word string, n_near long, best_n long, best string"))
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("top"))
            .select("word", "n_near", (-F.col("top.n")).alias("best_n"), F.col("top.word").alias("best")))


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``forms(word, form)``: the last word that following forms leads to."""
    links = forms.select(F.col("word").alias("at"), F.col("form").alias("next"))
    live = forms.select("word", F.col("form").alias("at"))
    steps, step = live.withColumn("step", F.lit(0)), 0
    while True:
        step += 1
        live = kept(live.join(links, "at").select("word", F.col("next").alias("at")))
        if not live.limit(1).count():
            return steps.groupBy("word").agg(F.max_by("at", "step").alias("root"))
        steps = steps.union(live.withColumn("step", F.lit(step)))


def variants(docs: DataFrame, min_letters: int = 7, min_count: int = 2, ratio: int = 10, plant: bool = False,
             piece_words: int = PIECE_WORDS) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of :func:`vocabulary`.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point;
    ``n_near`` counts a word's near words (0 if none).  ``form`` is the near word of largest n
    (ties: first in code-point order) if that n is at least ``ratio`` (2 or more) times the word's
    n, else null, and ``form_n`` its n; ``root`` follows forms to the last one (the word itself if
    it has none).

    Null, empty and wordless texts have no words; a null doc_id counts like any other row;
    repeated rows count repeatedly; further columns of ``docs`` are ignored; an empty table gives
    an empty result.  A word of any length is compared whole.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its word")
    words = stored(vocabulary(docs, min_letters, min_count, plant), "words")
    near = near_words(words, min_letters, piece_words)
    chosen = F.col("best_n") >= ratio * F.col("n")
    rows = stored(words.join(near, "word", "left").select(
        "word", F.when(chosen, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(chosen, F.col("best_n")).alias("form_n")), "near-words")
    roots = _roots(rows.where("form is not null").select("word", "form"))
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: DuckDB SQL of the registered query: near words by their parts with one letter left out
SQL = """
with recursive tokens as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
keyed as (
  select run, coalesce(doc_id::varchar, '') || ':' || run as s, count(*) as c from tokens
  where length(run) >= 7 group by doc_id, run),
hashed as (
  select run, c, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, strlen(s)),
             lambda k: ('0x' || substr(hex(encode(s)), 2 * k + 1, 2))::bigint)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
             lambda x, z: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295) as h
  from keyed),
slips as (
  select c, case when h % 31 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word
  from hashed),
words as (
  select word, cast(sum(c) as bigint) as n from slips where length(word) >= 7 group by word having sum(c) >= 2),
parts as (
  select word, n, i, left(word, i) || substr(word, i + 2) as part
  from (select word, n, unnest(range(0, length(word))) as i from words)),
pairs as (
  select x.word, y.word as other, y.n as other_n from parts x join parts y
    on x.part = y.part and x.i = y.i and x.word <> y.word
  union select x.word, y.word, y.n from parts x join words y on x.part = y.word
  union select y.word, x.word, x.n from parts x join words y on x.part = y.word),
near as (
  select word, count(*) as n_near, max(other_n) as best_n from pairs group by word),
forms as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when best_n >= 10 * w.n then best_n end as form_n,
         case when best_n >= 10 * w.n then (
           select min(p.other) from pairs p where p.word = w.word and p.other_n = best_n) end as form
  from words w left join near using (word)),
chain as (
  select word, form as last, 1 as step from forms where form is not null
  union all select c.word, f.form, step + 1 from chain c join forms f on f.word = c.last where f.form is not null)
select f.word, f.form, coalesce(max_by(c.last, c.step), f.word) as root, f.n, cast(f.n_near as bigint) as n_near,
       cast(f.form_n as bigint) as form_n
from forms f left join chain c on c.word = f.word
group by f.word, f.form, f.n, f.n_near, f.form_n
"""
