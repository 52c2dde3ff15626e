"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import collections
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import (dac, decontamination, html_text, langid, neighbours, packing, quality, secrets,
                            sharding, simhash)
from ledgerlens.llm.common import new_path

LONG = "alpha beta gamma delta " * 6000
SECRET = "0123456789abcdef0123456789abcdef01234567"
ROWS = [
    (1, None, "en", "s"), (2, "", None, "s"), (3, "the cat sat on the mat again today friend", "en", None),
    (3, "the cat sat on the mat again today friend", "en", None),        # repeated row
    (4, LONG, "en", "s"), (None, "an id is missing here my friend", "en", "s"), (5, "  \n\t ", "de", "t"),
    (6, f'my token = "{SECRET}" is here', "en", "t"), (7, "ünï çödé ßtraße 漢字 \U0001f600", "de", "t"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: names that the operators use inside
CLASH = ("score", "n", "words", "ids", "found", "key", "fp", "row", "host", "low", "queue", "value", "h", "item")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit("mine") for c in CLASH}).coalesce(2)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def _ids(name, end):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [end], "<u4") for r in ROWS]


def test_simhash(spark, docs, none):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    want = sorted(((r[0], f"{simhash.text_fingerprint(r[1]):016x}") for r in ROWS), key=str)
    assert sorted(((a, b) for a, b, _ in got), key=str) == want
    by_id = {a: c for a, _, c in got}
    assert by_id[1] == by_id[2] == by_id[5] == 1 and by_id[3] == 3      # wordless texts: one group
    assert simhash.near_duplicates(none).count() == 0


def test_packing_round_trip(spark, docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack(docs, path, end_id=0, sequence_tokens=64).toPandas().sort_values(["sequence_id", "offset"])
    assert rows["length"].sum() == sum(map(len, _ids("byte_bpe_50k.json", 0)))
    sizes = rows.groupby("sequence_id")["length"].sum()
    assert (sizes.iloc[:-1] == 64).all() and list(sizes.index) == list(range(len(sizes)))
    assert (rows.groupby("sequence_id")["length"].cumsum() - rows["length"] == rows["offset"]).all()
    last = rows["padded_to"].iloc[-1]
    assert last & (last - 1) == 0 and last >= sizes.iloc[-1]
    four = rows[rows["doc_id"] == 4].sort_values("start")
    assert b"".join(four["ids"]) == _ids("byte_bpe_50k.json", 0)[4].tobytes()
    assert packing.pack(none, path, end_id=0).count() == 0


def test_packing_keeps_the_mixture(spark):
    rows = [(i, "word " * 40, None, "ab"[i % 3 == 0]) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, sequence_tokens=300).toPandas()
    share = got.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum").fillna(0)
    share = share.iloc[:-1]
    assert (abs(share["b"] / 300 - 1 / 3) < 0.02).all()


def test_token_files_round_trip(spark, docs, none):
    path = new_path(spark, "test-dac")
    dac.write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=1, segment_tokens=500)
    got = dac.read_documents(spark, path).orderBy("start").collect()
    want = _ids("word_bpe_49k.json", 1)
    order = sorted(range(len(ROWS)), key=lambda i: (ROWS[i][0] is not None, ROWS[i][0] or 0))
    assert [r.doc_id for r in got] == [ROWS[i][0] for i in order]
    assert [bytes(r.ids) for r in got] == [want[i].tobytes() for i in order]
    stream = np.concatenate([want[i] for i in order])
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([len(want[i]) for i in order])])[:-1].tolist()
    picks = [0, 1, 5, len(stream) - 1, len(stream) // 2, 5, len(stream) + 9]
    wanted = spark.createDataFrame([(p,) for p in picks], "position long")
    found = sorted((r.position, r.token) for r in dac.tokens_at(spark, path, wanted).collect())
    assert found == sorted((p, int(stream[p])) for p in picks if p < len(stream))
    empty = new_path(spark, "test-dac")
    dac.write_token_files(none, empty, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    assert dac.read_documents(spark, empty).count() == 0


def test_segment_gets_any_token():
    rng = np.random.default_rng(3)
    for values in (rng.integers(0, 49408, 5000), rng.integers(0, 1 << 20, 3000), np.array([0]), np.array([255, 256])):
        seg = dac.Segment(dac.pack_segment(values))
        assert (seg.all() == values).all()
        at = rng.integers(0, len(values), 500)
        assert (seg.get(at) == values[at]).all()


def test_sharding(spark, docs, none):
    got = sharding.shard_rows(docs, shards=4).collect()
    sizes = [len([r for r in got if r.shard == s]) for s in range(4)]
    assert sum(sizes) == len(ROWS) and max(sizes) - min(sizes) <= 1
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    assert sharding.shard_rows(none).count() == 0


@pytest.mark.parametrize("place_rows", [sharding.PLACE_ROWS, 100])
@pytest.mark.parametrize("slack", [0.0, 0.1])
def test_sharding_by_a_walk_of_every_key(spark, slack, place_rows):
    """A third of the rows share an id (with texts of their own), some have none."""
    docs = spark.range(3_000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id")).alias("doc_id"),
        F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    got = sharding.shard_rows(docs, 5, vnodes=16, slack=slack, place_rows=place_rows).toPandas()
    assert len(got) == 3_000 and got["text_crc32"].nunique() == 3_000
    for _, mine in got.groupby("shard"):
        assert sorted(mine["slot"]) == list(range(len(mine)))
    place = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))),
                                 64 - sharding.RING_BITS)
    points = sharding.ring(5, 16)
    arcs = dict(sharding.arcs(points))
    keys = sorted((arcs[r.place], r.place, r.crc) for r in docs.select(place.alias("place"), F.crc32(F.col("text").cast("binary")).alias("crc")).collect())
    room, want = sharding.capacities(3_000, 5, slack), {}
    for arc, at, _ in keys:                            # clockwise from its arc to a shard with room
        step = arc
        while not room[points[step % len(points)][1]]:
            step += 1
        room[points[step % len(points)][1]] -= 1
        want.setdefault(at, []).append(points[step % len(points)][1])
    by_crc = {k[2]: k[1] for k in keys}
    found = {}
    for crc, shard in zip(got["text_crc32"], got["shard"]):
        found.setdefault(by_crc[crc], []).append(shard)
    assert {p: sorted(x) for p, x in found.items()} == {p: sorted(x) for p, x in want.items()}


def test_sharding_spreads_repeats_and_moves_little(spark):
    same = spark.range(30_000).select(F.lit(1).alias("doc_id"), F.lit("x").alias("text"))
    sizes = [r["count"] for r in sharding.shard_rows(same, 7).groupBy("shard").count().collect()]
    assert sum(sizes) == 30_000 and max(sizes) - min(sizes) <= 1
    many = spark.range(8_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    a = sharding.shard_rows(many, 8, slack=0.1).select("doc_id", F.col("shard").alias("a"))
    b = sharding.shard_rows(many, 9, slack=0.1).select("doc_id", F.col("shard").alias("b"))
    assert a.join(b, "doc_id").where("a <> b").count() < 8_000 * 0.35      # dealing by modulus moves 8 of 9


def test_decontamination(spark, docs, none):
    items = [(1, "cat sat on the mat AGAIN today"), (2, "Alpha beta gamma delta alpha beta gamma delta alpha beta gamma"),
             (3, None), (4, "..."), (None, "missing here"), (1, "cat sat on the mat AGAIN today")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {str(r.doc_id): r for r in decontamination.contamination(docs, bench).collect()}
    assert got["3"].n_hit == 7 and got["3"].n_items == 1 and got["3"].contaminated
    assert got["4"].n_words == 24_000 and got["4"].n_hit == 23_999        # no window ends on the last word
    assert got["1"].n_words == 0 and not got["2"].contaminated
    assert got["None"].n_hit == 2 and got["None"].n_items == 0 and got["None"].contaminated
    assert decontamination.contamination(docs, bench).count() == len(ROWS)
    assert set(docs.columns) <= set(decontamination.contamination(docs, bench).columns)
    assert decontamination.contamination(none, bench).count() == 0
    bare = decontamination.contamination(docs, bench.where("false"))
    assert bare.where("contaminated").count() == 0 and bare.count() == len(ROWS)
    shuffled = decontamination.contamination(docs, bench, broadcast_rows=0)
    assert shuffled.where("contaminated").count() == 4


def test_secrets(spark, docs, none):
    got = secrets.scanned(docs)
    assert got.count() == len(ROWS) and set(docs.columns) <= set(got.columns)
    assert [r.secrets for r in got.where("doc_id = 6").collect()] == [[SECRET]]
    assert got.where("doc_id <> 6 and size(secrets) > 0").count() == 0
    masked = got.where("doc_id = 6").select(secrets.redacted().alias("t")).first().t
    assert masked == 'my token = "[SECRET]" is here'
    assert secrets.scanned(none).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(3, 1), (4, 0), (6, 1), (None, 1), (7, None), (3, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels, dims=2)
    got = quality.scored(docs, model)
    assert got.count() == len(ROWS) and set(docs.columns) <= set(got.columns)
    scores = {r.doc_id: r.score for r in got.collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[1] == scores[2] == pytest.approx(2 / 3)
    bare = quality.fit(docs, labels.where("false"))
    assert [r.score for r in quality.scored(docs, bare).select("score").distinct().collect()] == [0.5]
    assert quality.scored(none, model).count() == 0


def test_langid(spark, docs, none):
    model = langid.fit(docs)
    got = langid.identified(docs, model)
    assert got.count() == len(ROWS) and set(docs.columns) <= set(got.columns)
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[1].lang_pred == by_id[2].lang_pred == by_id[5].lang_pred == "und"
    assert by_id[4].lang_pred == "en" and by_id[7].lang_pred == "de"
    assert langid.identified(none, model).count() == 0
    nothing = langid.fit(none)
    assert {r.lang_pred for r in langid.identified(docs, nothing).collect()} == {"und"}


def test_kneser_ney_is_a_distribution():
    texts = ["abab abba baba", "abc cab bca"]
    codes, _, scored = langid.symbols(texts)
    keys, counts = np.unique(langid.grams(codes, 4)[scored[3:]], return_counts=True)
    model = langid.Model(["x"], keys, np.zeros(len(keys), np.int64), counts)
    for context in (0, int(keys[3]) >> 16, int(keys[0]) >> 16):
        every = np.array([(context << 16 | c) & ((1 << 64) - 1) for c in range(1 << 16)], np.uint64)
        assert model.probability(4, every).sum() == pytest.approx(1, abs=1e-3)


def _plain_kneser_ney(text_grams):
    """Probability of a tuple of symbols by the textbook recursion over dictionaries."""
    tables = {langid.ORDER: collections.Counter(text_grams)}
    for n in range(langid.ORDER - 1, 0, -1):
        tables[n] = collections.Counter(g[1:] for g in tables[n + 1])

    def probability(gram):
        if not gram:
            return 1 / (1 << 16)
        table = tables[len(gram)]
        once, twice = (sum(c == x for c in table.values()) for x in (1, 2))
        discount = once / (once + 2 * twice) if once else 0.5
        after = [c for g, c in table.items() if g[:-1] == gram[:-1]]
        lower = probability(gram[1:])
        if not after:
            return lower
        return (max(table[gram] - discount, 0) + discount * len(after) * lower) / sum(after)
    return probability


def test_language_models_by_brute_force():
    texts = {"a": "abab abba baba cab", "b": "abc cab bca zzz abab", "c": "x"}
    keys, langs, counts, plain = [], [], [], []
    for i, text in enumerate(texts.values()):
        codes, _, scored = langid.symbols([text])
        packed = langid.grams(codes, 4)[scored[3:]]
        k, n = np.unique(packed, return_counts=True)
        keys.append(k), langs.append(np.full(len(k), i)), counts.append(n)
        plain.append(_plain_kneser_ney([tuple(int(g) >> 16 * j & 0xFFFF for j in (3, 2, 1, 0)) for g in packed]))
    model = langid.Model(list(texts), *map(np.concatenate, (keys, langs, counts)))
    asked = np.unique(np.concatenate([*keys, np.array([0, 97, 97 << 48 | 98 << 32 | 99 << 16 | 122], np.uint64)]))
    got = model.probability(4, asked)
    for g, row in zip(asked, got):
        want = [p(tuple(int(g) >> 16 * j & 0xFFFF for j in (3, 2, 1, 0))) for p in plain]
        assert row.tolist() == pytest.approx(want, rel=1e-4)


def test_sixty_languages_and_one_of_a_single_short_document(spark):
    rng = np.random.default_rng(8)
    words = {f"l{i:02d}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(40)] for i in range(60)}
    rows = [(i * 100 + j, " ".join(rng.choice(w, 30)), lang) for i, (lang, w) in enumerate(words.items()) for j in range(20)]
    rows.append((99_999, "zqzqz", "short"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id % 4 <> 0"))
    assert len(model.languages) == 61
    assert len(model.own[4].values) < 2 * len(model.own[4].hashes)       # entries, not n-grams x languages
    got = langid.identified(docs.where("doc_id % 4 = 0"), model).select("lang", "lang_pred").toPandas()
    assert len(got) == 300 and (got["lang"] == got["lang_pred"]).mean() >= 0.98


def test_neighbours(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]),
            (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [1.0]), (0, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit(1))
    got = neighbours.nearest(df, F.col("vec_id") % 100 == 0, k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [
        (0, 1, 1), (0, 2, 7), (0, 3, 100), (100, 1, 0), (100, 2, 1), (100, 3, 7)]
    assert got[0].score == 0.0 and got[2].score == pytest.approx(2 ** 0.5)
    assert neighbours.nearest(df.where("false"), F.lit(True)).count() == 0


def test_neighbours_of_equal_vectors_are_the_smallest_ids(spark):
    rng = np.random.default_rng(5)
    same, rest = rng.standard_normal(64), rng.standard_normal((400, 64))
    rows = [(i, same.tolist()) for i in range(0, 500, 10)] + [(1001 + i, v.tolist()) for i, v in enumerate(rest)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    got = neighbours.nearest(df, F.col("vec_id") % 100 == 0, k=10).orderBy("query_id", "rank").collect()
    for q in (0, 100, 200, 300, 400):
        mine = [r for r in got if r.query_id == q]
        assert [r.vec_id for r in mine] == [i for i in range(0, 500, 10) if i != q][:10]
        assert all(r.score == 0.0 for r in mine)


def test_neighbours_verify_a_part_of_the_rows(spark):
    """20,000 unit vectors without clusters: under half are verified, recall is at least 0.95."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}))
    got = neighbours.nearest(df, F.col("vec_id") % 200 == 0, k=10).toPandas()
    hits = 0
    for q in range(0, len(x), 200):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10]) & set(got["vec_id"][got["query_id"] == q]))
    asked = got.drop_duplicates("query_id")
    verified, blocks = asked["verified"].mean() / len(x), asked["blocks"].mean()
    print(f"verified {verified:.3f} of all rows in {blocks:.1f} blocks a query, recall {hits / 1000:.3f}")
    assert verified < 0.5 and hits / 1000 >= 0.95


def test_equal_texts_get_equal_quality_scores():
    texts = [f"word {i % 37} of a text {i % 11} " * (1 + i % 5) for i in range(300)]
    terms = np.array([quality.term_vector(t) for t in texts])
    model = quality.fit_terms(terms, (np.arange(300) % 3 == 0).astype(float))
    at_once = model.scores(terms)
    one_by_one = np.concatenate([model.scores(terms[i:i + 1]) for i in range(300)])
    assert (at_once == one_by_one).all() and (model.scores(terms[::-1].copy())[::-1] == at_once).all()


def test_quality_ties_go_to_the_vectors_that_come_first():
    vectors = np.repeat(np.eye(3), 20, axis=0)
    labels = np.r_[np.ones(10), np.zeros(10), np.zeros(40)]
    model = quality.Model(np.ones(quality.TERMS), np.zeros((0, 0)), vectors, labels)
    model.latent = lambda terms: terms
    assert model.scores(np.eye(3)).tolist() == [1.0, 0.0, 0.0]


PAGE = """<html><head><title>t</title></head><body><div class="top">Site name</div><nav>menu</nav>
<div class=body><p>First &amp; {0}<br>line {0}</p><p><b>Second {0}<p>Third&nbsp;{0}</div>
<script>var x="</p>";</script><div class="comments">hi</div><div class="base">All rights</div></body></html>"""


def test_html(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(i)) for i in range(30)]
    rows += [(99, None, PAGE.format("x")), (98, "http://b.example/", None), (97, "nonsense", ""), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {c: F.lit("mine") for c in ("text", "host", "low", "row", "path")})
    got = html_text.extracted(df)
    assert got.count() == len(rows) and set(got.columns) == set(df.columns)
    text = {r.page_id: r.text for r in got.collect()}
    assert text[7] == "First & 7 line 7\n\nSecond 7\n\nThird 7"       # the site's own lines are gone
    assert text[99] == "Site name\n\nFirst & x line x\n\nSecond x\n\nThird x\n\nAll rights"
    assert text[98] == text[97] == ""
    assert html_text.extracted(df.where("false")).count() == 0


@pytest.mark.parametrize("html", ["<", "<p", "<a href=\"x", "<!--", "<![CDATA[x", "</p></div>", "<p>" * 3000,
                                  "<div>" * 3000 + "x", "a<br/>b<hr>c", "<script>x", "&#x41;&bogus;&#99999999;", "\x00<p>\ud800"])
def test_broken_html_is_read(html):
    assert isinstance(html_text.main_text(html), str)


def test_article_wins_over_the_rest_of_the_page():
    page = "<body><p>aside</p><article><header><h1>T</h1></header><p>x</p><footer>f</footer></article><p>more</p>"
    assert html_text.main_text(page) == "T\n\nx"


def test_site_boilerplate_inside_articles_goes(spark):
    page = ("<body><{1}><h1>Title {0}</h1><p>Words of page {0} only</p>"
            "<div class=box>Sign our petition today</div></{1}></body>")
    rows = [(i, f"http://{tag}.example/{i}", page.format(i, tag)) for tag in ("article", "main") for i in range(30)]
    rows += [(i, f"http://two.example/{i}", page.format("of a near copy", "article") + f"<nav>{i}</nav>") for i in (90, 91)]
    rows += [(i, f"http://same.example/{i}", page.format("the", "article") + f"<nav>{i}</nav>") for i in range(190, 200)]
    got = html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {(r.page_id, r.url): r.text for r in got}
    for i, url, _ in rows[:60]:
        assert text[i, url] == f"Title {i}\n\nWords of page {i} only"
    assert text[199, "http://same.example/199"] == "Title the\n\nWords of page the only\n\nSign our petition today"
    assert text[90, "http://two.example/90"].startswith("Title of a near copy")       # two pages prove no template


def test_article_teaser_does_not_replace_the_body():
    body = "The story itself goes on and on. " * 40
    page = f"<body><article class=box><p>Read this too</p></article><div class=story><p>{body}</p></div></body>"
    assert " ".join(body.split()) in html_text.main_text(page)
    page = f"<body><main><article>Read this too</article><p>{body}</p></main><p>outside</p></body>"
    assert html_text.main_text(page) == "Read this too\n\n" + " ".join(body.split())


def _same_as_plain(name, texts):
    import pyarrow as pa
    from tokenizers import Tokenizer
    from ledgerlens.llm.tokens import Encoder
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    (_, ids, bounds), = Encoder(public_tokenizers.path(name)).encode(pa.array(texts))
    got = [ids[bounds[i]:bounds[i + 1]].tolist() for i in range(len(texts))]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_carriage_returns_keep_their_ids(name):
    _same_as_plain(name, ["one \r\ntwo", "one \rtwo", "\rone", "one\r\ntwo\r\n", "a \r b", "\r", " \r", "one two", ""])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_token_spellings_as_in_a_plain_call(name):
    _same_as_plain(name, ["end <|endoftext|> next", "<|endoftext|>", "a<|endoftext|>b\n<|startoftext|>", "<|EndOfText|> x",
                          "<| endoftext |>", "one two"])


def test_secrets_of_a_clean_corpus(spark):
    import hashlib
    import uuid
    rows = []
    for i in range(40):
        digest = hashlib.sha1(str(i).encode()).hexdigest()
        rows.append((i, f"See https://www.example.org/articles/2020/1{i % 9}/a-long-title-number-{i} and commit {digest} of "
                        f"the file report_2020_11_{i}_final_version. The id {uuid.UUID(int=i * 7 ** 40)} has "
                        f"md5: {hashlib.md5(digest.encode()).hexdigest()} here.", "en", "web"))
    df = spark.createDataFrame(rows, SCHEMA)
    got = secrets.scanned(df).collect()
    assert all(r.n_candidates >= 4 for r in got) and [r.secrets for r in got if r.secrets] == []
    few = df.where("doc_id < 3").union(spark.createDataFrame([(99, f"password: {SECRET} is unquoted", "en", "web")], SCHEMA))
    assert {r.doc_id: r.secrets for r in secrets.scanned(few).collect()} == {0: [], 1: [], 2: [], 99: [SECRET]}


def test_secrets_assigned_to_names(spark):
    held = [("AWS_SECRET_ACCESS_KEY=%s", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"), ("GET /x?token=%s&user=bob", "abc123def456gh7"),
            ('password = "%s"', "hunter2!"), ("db_password: %s", "s3cr3t.Pa$$w0rd"), ('{"api_key": "%s"}', "Zx81-qq.77~tt"),
            ("github_token='%s'", "ghp_a1B2c3D4e5F6g7H8"), ("export DB_PASSWD=%s", "Ab1!cd2@ef")]
    plain = ["the key: something else", "password: required", '"password": "required"', "monkey = abc12345"]
    rows = [(i, line % value, "en", "web") for i, (line, value) in enumerate(held)]
    rows += [(100 + i, line, "en", "web") for i, line in enumerate(plain)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {(r.doc_id, r.value) for r in secrets.candidates(df).collect()}
    assert {(i, v) for i, (_, v) in enumerate(held)} <= found and not [d for d, _ in found if d == 103]
    got = {r.doc_id: r.secrets for r in secrets.scanned(df).collect()}
    assert got == {i: [held[i][1]] if i < 100 else [] for i in got}


@pytest.mark.parametrize("weights", [None, {"s1": 5.0, "s2": 1.0, "s17": 0.5}])
def test_packing_of_many_sources_is_the_same(spark, weights):
    rows = [(i, "some words " * (i % 7 + 1), None, f"s{i % 23}") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(3)
    path = public_tokenizers.path("byte_bpe_50k.json")
    few, many = ([tuple(r) for r in packing.pack(df, path, end_id=0, sequence_tokens=64, weights=weights, max_queues=m)
                  .orderBy("sequence_id", "offset").collect()] for m in (4096, 5))
    assert few == many and {r[1] for r in many} == {f"s{i}" for i in range(23)}
