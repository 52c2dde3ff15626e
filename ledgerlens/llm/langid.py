"""Language identification by interpolated Kneser-Ney character models.

A text is lowered, every run of characters that are no letters becomes one space, and each
language has a model of order ``ORDER`` over what is left.  For each order, the n-grams of all
languages are kept in one array sorted by hash, with the interpolated probability in every
language beside it; n-grams that no language has seen fall back over the context's back-off
mass to the next lower order.  The language of the lowest cross-entropy a symbol wins; the
calibrated limit of that language tells whether the text is rejected as none of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import crc32_text

ORDER = 4
#: symbols scored at a time
CHUNK = 1 << 19
#: characters that are prepared together (a longer text goes alone)
SLICE = 1 << 20
#: odd multiplier: a one-to-one hash of the packed n-gram (16 bits a symbol)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: texts with fewer symbols are never rejected
REJECT_SYMBOLS = 50
#: share of held-back training texts that the rejection limit lets pass
PASS = 0.995
#: symbols whose evidence the score counts at most
SCORE_SYMBOLS = 50
#: starts of texts: the context that has no symbol
MARK = "\x01"

_LETTERS: list[np.ndarray] = []


def _symbols() -> np.ndarray:
    """Code of a character: itself folded to 16 bits if a letter, a space (32) if not."""
    if not _LETTERS:
        codes = np.arange(0x110000, dtype=np.uint32)
        letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        _LETTERS.append(np.where(letter, np.maximum(codes & 0xFFFF, 33), 32).astype(np.uint16))
    return _LETTERS[0]


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, text number, scored) of the symbols of texts, each after ``ORDER - 1`` marks."""
    pad = MARK * (ORDER - 1)
    whole = [pad + t.lower() for t in texts]
    lens = np.fromiter(map(len, whole), np.int64, len(whole))
    chars = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), "<u4")
    codes = _symbols()[chars]
    letter, mark = codes != 32, chars == 1
    before = np.concatenate([[False], letter[:-1]])
    use = letter | mark | before                  # of a run of others, the first
    text = np.repeat(np.arange(len(texts)), lens)
    return codes[use], text[use], ~mark[use]


def grams(codes: np.ndarray, order: int) -> np.ndarray:
    """Packed n-grams that end at each symbol from the ``ORDER``-th on."""
    out = np.zeros(len(codes) - ORDER + 1, np.uint64)
    for j in range(order):
        at = ORDER - order + j
        out = out << np.uint64(16) | codes[at:at + len(out)].astype(np.uint64)
    return out


class Table:
    """A hash array sorted by hash and language: an n-gram has an entry for each language that
    knows it, and no room is kept for the others."""

    def __init__(self, keys: np.ndarray, langs: np.ndarray, values: np.ndarray):
        hashed = keys * MULTIPLIER
        order = np.lexsort((langs, hashed))
        hashed = hashed[order]
        self.langs, self.values = langs[order].astype(np.int32), values[order].astype(np.float32)
        first = np.flatnonzero(np.r_[True, hashed[1:] != hashed[:-1]]) if len(hashed) else np.zeros(0, np.int64)
        self.hashes, self.bounds = hashed[first], np.r_[first, len(hashed)]

    def spread(self, keys: np.ndarray, out: np.ndarray) -> None:
        """Sets ``out[i, language]`` to the entries of each key."""
        if not len(self.hashes):
            return
        hashed = keys * MULTIPLIER
        at = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
        rows = np.flatnonzero(self.hashes[at] == hashed)
        start, size = self.bounds[at[rows]], np.diff(self.bounds)[at[rows]]
        entry = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        out[np.repeat(rows, size), self.langs[entry]] = self.values[entry]


def _sums(keys: np.ndarray, langs: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the entries of equal (key, language), in that order."""
    order = np.lexsort((langs, keys))
    keys, langs, values = keys[order], langs[order], values[order]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (langs[1:] != langs[:-1])] if len(keys) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return keys[first], langs[first], np.add.reduceat(values, first) if len(first) else values


class Model:
    """Interpolated Kneser-Ney models of all languages, and their rejection limits."""

    def __init__(self, languages: list[str], keys: np.ndarray, langs: np.ndarray, counts: np.ndarray):
        """``counts[i]``: occurrences of the ``ORDER``-gram ``keys[i]`` in language ``langs[i]``."""
        self.languages, self.limits = languages, np.full(len(languages), np.inf)
        #: by order: what an n-gram has beyond the lower order, and the weight of the lower order after a context
        self.own: list[Table] = [None] * (ORDER + 1)
        self.back: list[Table] = [None] * (ORDER + 1)
        by_order = {ORDER: _sums(keys, langs, counts.astype(np.float64))}
        for order in range(ORDER - 1, 0, -1):     # continuation counts: distinct left neighbours
            above, who, _ = by_order[order + 1]
            by_order[order] = _sums(above & np.uint64((1 << 16 * order) - 1), who, np.ones(len(above)))
        for order in range(1, ORDER + 1):
            k, who, c = by_order[order]
            n1, n2 = (np.bincount(who[c == x], minlength=len(languages)) for x in (1, 2))
            discount = np.where(n1 > 0, n1 / np.maximum(n1 + 2 * n2, 1), 0.5)
            context, speaker, total = _sums(k >> np.uint64(16), who, c)
            _, _, kinds = _sums(k >> np.uint64(16), who, np.ones(len(k)))
            # entries are sorted by (key, language), so those of a context are found by rank
            _, at = np.unique((k >> np.uint64(16)) * np.uint64(len(languages) or 1) + who.astype(np.uint64), return_inverse=True)
            self.own[order] = Table(k, who, np.maximum(c - discount[who], 0) / total[at])
            self.back[order] = Table(context, speaker, discount[speaker] * kinds / total)

    def probability(self, order: int, keys: np.ndarray) -> np.ndarray:
        """Interpolated probability of the last symbol in every language, from the lowest order up;
        each distinct n-gram is looked up once."""
        distinct, where = np.unique(keys, return_inverse=True)
        return self._distinct(order, distinct)[where]

    def _distinct(self, order: int, keys: np.ndarray) -> np.ndarray:
        if not order:
            return np.full((len(keys), len(self.languages)), 1.0 / (1 << 16), np.float32)
        lower = self.probability(order - 1, keys & np.uint64((1 << 16 * (order - 1)) - 1))
        own, back = np.zeros_like(lower), np.ones_like(lower)
        self.own[order].spread(keys, own)
        self.back[order].spread(keys >> np.uint64(16), back)
        return own + back * lower

    def entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nats a symbol in every language, symbols, has a letter) of whole texts."""
        width = len(self.languages)
        loss, n = np.zeros((len(texts), width)), np.zeros(len(texts))
        letters = np.zeros(len(texts), bool)
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= SLICE):
                size += len(texts[to])
                to += 1
            codes, text, scored = symbols(texts[at:to])
            letters[at:to] = np.bincount(text, (codes != 32) & scored, minlength=to - at) > 0
            for lo in range(ORDER - 1, len(codes), CHUNK):
                hi = min(lo + CHUNK, len(codes))
                use = scored[lo:hi]
                which = text[lo:hi][use]
                cost = -np.log(np.maximum(
                    self.probability(ORDER, grams(codes[lo - ORDER + 1:hi], ORDER)[use]), 1e-30))
                n[at:to] += np.bincount(which, minlength=to - at)
                for lang in range(width):
                    loss[at:to, lang] += np.bincount(which, cost[:, lang], minlength=to - at)
            at = to
        return loss / np.maximum(n, 1)[:, None], n, letters

    def predict(self, texts: list[str]) -> pd.DataFrame:
        ce, n, letters = self.entropy(texts)
        if not self.languages:
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0, "cross_entropy": np.nan,
                                 "rejected": True})
        best = ce.argmin(axis=1)
        low = ce[np.arange(len(ce)), best]
        evidence = np.minimum(n, SCORE_SYMBOLS)[:, None] * (ce - low[:, None])
        score = np.where(letters, 1 / np.exp(-np.minimum(evidence, 700)).sum(axis=1), 0.0)
        names = np.where(letters, np.array(self.languages, object)[best], "und")
        far = (low > self.limits[best]) & (n >= REJECT_SYMBOLS)
        return pd.DataFrame({"lang_pred": names, "score": score,
                             "cross_entropy": np.where(letters, low, np.nan), "rejected": far | ~letters})


def count_grams(texts: DataFrame) -> pd.DataFrame:
    """Counts of the ``ORDER``-grams of ``texts(lang, part, text)`` by language and part: each
    task counts its own batches, the sums meet by n-gram."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (lang, part), rows in b.groupby(["lang", "part"]):
                codes, _, scored = symbols(rows["text"].tolist())
                keys, counts = np.unique(grams(codes, ORDER)[scored[ORDER - 1:]], return_counts=True)
                yield pd.DataFrame({"lang": lang, "part": part, "gram": keys.view(np.int64), "n": counts})

    return (texts.mapInPandas(run, "lang string, part int, gram long, n long")
            .groupBy("lang", "part", "gram").agg(F.sum("n").alias("n")).toPandas())


def fit(docs: DataFrame, max_docs: int = 1000) -> Model:
    """Learns from rows of ``docs(doc_id, text, lang)`` with a text and a language.

    Of each language about ``max_docs`` whole documents are used, those of the smallest doc_id
    hashes; a fifth of them (by hash) only calibrates the rejection limit.  So the model is
    bounded by the languages and this parameter, whatever the corpus.
    """
    rows = docs.where("lang is not null and text is not null and doc_id is not null")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    draw = F.xxhash64("doc_id") / F.lit(float(1 << 63))                       # -1 to 1
    chosen = (rows.select("doc_id", "lang", "text").join(F.broadcast(sizes), "lang")
              .where((draw + 1) / 2 < F.lit(float(max_docs)) / F.col("docs"))
              .select("lang", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)).cast("int").alias("part"), "text"))
    counts = count_grams(chosen)
    languages = sorted(counts["lang"].unique())
    train = counts[counts["part"] != 0] if (counts["part"] != 0).any() else counts
    number = {lang: i for i, lang in enumerate(languages)}
    model = Model(languages, train["gram"].to_numpy(np.int64).view(np.uint64),
                  train["lang"].map(number).to_numpy(np.int64), train["n"].to_numpy())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ce, n, letters = model.entropy(b["text"].tolist())
            own = ce[np.arange(len(ce)), [languages.index(x) for x in b["lang"]]]
            use = letters & (n >= REJECT_SYMBOLS)
            yield pd.DataFrame({"lang": b["lang"][use], "ce": own[use]})

    limits = chosen.where("part = 0").mapInPandas(run, "lang string, ce double").groupBy("lang").agg(
        F.percentile("ce", F.lit(PASS)).alias("limit")).collect()            # a row a language
    for row in limits:
        model.limits[languages.index(row["lang"])] = row["limit"]
    return model


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` (``und`` if the text is null or has no letter, or no language was
    learned), ``score`` (0 to 1), ``cross_entropy`` and ``rejected`` (the text is not like its
    nearest language; always true for ``und``).

    Only the whole ``text`` is an input.  Ties go to the first language by name; columns of these
    names are replaced, all others kept; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = ["lang_pred", "score", "cross_entropy", "rejected"]

    @F.pandas_udf("lang_pred string, score double, cross_entropy double, rejected boolean")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield shared.value.predict(["" if t is None else t for t in batch])

    rows = docs.drop(*new).select(F.struct(F.col("*")).alias("row"), predict("text").alias("found"))
    return rows.select("row.*", "found.*")


def held_out():
    """Rows that are never learned from: crc32(doc_id as text) mod 3 is 1."""
    return F.coalesce(F.pmod(crc32_text(), F.lit(3)) == 1, F.lit(False))
