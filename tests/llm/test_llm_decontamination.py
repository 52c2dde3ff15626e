"""Decontamination against a comparison of every window, and on texts of repeated words."""

import random
from hashlib import sha256

import pytest

from ledgerlens.llm import decontamination

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def _by_windows(doc: str, items: list[tuple[int, str]]) -> tuple[int, int, str]:
    words, hit, named = doc.split(), set(), set()
    for item_id, text in items:
        item = text.split()
        size = min(len(item), 10)
        windows = {tuple(item[j:j + size]) for j in range(len(item) - size + 1)} if size else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i:i + size]) in windows:
                hit.update(range(i, i + size))
                named.add(str(item_id))
    return len(hit), len(named), sha256(",".join(sorted(named)).encode()).hexdigest()


@pytest.mark.parametrize("broadcast_rows", [decontamination.BROADCAST_ROWS, 0])
def test_every_window_by_brute_force(spark, broadcast_rows):
    draw = random.Random(7)
    items = [(i, " ".join(draw.choices("abc", k=draw.choice([1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 14, 30])) if i % 3
                          else draw.choices(["x", "y"], weights=[9, 1], k=25))) for i in range(24)]
    texts = [" ".join(draw.choices("abcde", k=draw.randrange(60))) for _ in range(40)]
    texts += [" ".join(draw.choices(["x", "y", "z"], weights=[30, 3, 1], k=200)) for _ in range(10)]
    for i in range(30):                           # pieces of items between other words
        item = items[draw.randrange(24)][1].split()
        cut = draw.randrange(len(item))
        texts.append(" ".join(["u"] * draw.randrange(4) + item[cut:cut + 12] + ["v"] * draw.randrange(4)))
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = decontamination.contamination(docs, spark.createDataFrame(items, ITEMS), broadcast_rows=broadcast_rows)
    found = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in got.collect()}
    assert found == {i: _by_windows(t, items) for i, t in enumerate(texts)}


def test_repeated_words_cost_in_proportion(spark):
    docs = spark.createDataFrame([(1, "a " * 20_000), (2, "b " * 30 + "a " * 9 + "b " * 30)], DOCS)
    bench = spark.createDataFrame([(i, "a " * 100) for i in range(20)], ITEMS)
    spans, items = decontamination._spans(docs, bench, 10, decontamination.BROADCAST_ROWS)
    # surroundings of up to five words to either side: 6 x 6 kinds, whatever the items' number
    assert items.select("class").distinct().count() <= 36
    assert spans.count() <= 36 * 20_000 and spans.where("stop - start > 15").count() == 0
    got = {r.doc_id: r for r in decontamination.contamination(docs, bench).collect()}
    assert (got[1].n_hit, got[1].n_items, got[2].n_hit) == (20_000, 20, 0)
