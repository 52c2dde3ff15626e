"""Every registered operator query over whole tables, against brute force or truth."""

import html
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import golay, queries, simhash

SF = "/root/testdata/sf0.001"


def _table(name):
    return ds.dataset(f"{SF}/{name}.parquet").to_table().to_pandas()


@pytest.fixture(scope="module")
def documents():
    return _table("documents").sort_values("doc_id").reset_index(drop=True)


def _run(spark, name):
    return queries.QUERIES[name](spark, SF).toPandas()


def test_all_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_op1_recall(spark):
    e = _table("embeddings")
    x, ids = np.stack(e["embedding"]).astype(float), e["vec_id"].to_numpy()
    got = _run(spark, "op1_neighbours")
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:10]
        mine = got[got["query_id"] == q].sort_values("rank")
        hits += len(set(mine["vec_id"]) & set(ids[best]))
        total += 10
        assert list(mine["rank"]) == list(range(1, 11)) and mine["score"].is_monotonic_increasing
    assert hits / total >= 0.9


def test_op2_held_out_accuracy(spark, documents):
    got = _run(spark, "op2_langid").merge(documents, on="doc_id")
    assert len(got) == len(documents) and got["score"].between(0, 1).all()
    held = got[got["held_out"]]
    assert (held["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in held["doc_id"]]).all()
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97


def _ids(documents, name, end):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array(e.ids + [end], "<u4")
            for e in t.encode_batch(documents["text"].fillna("").tolist(), add_special_tokens=False)]


def test_op3_pieces_hold_every_token(spark, documents):
    got = _run(spark, "op3_packing")
    want = dict(zip(documents["doc_id"], _ids(documents, "byte_bpe_50k.json", 0)))
    for r in got.itertuples():
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids) and zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
    got = got.sort_values(["doc_id", "start"])
    assert (got.groupby("doc_id")["length"].cumsum() - got["length"] == got["start"]).all()
    assert got["length"].sum() == sum(map(len, want.values()))
    sizes = got.groupby("sequence_id")["length"].sum()
    assert (sizes.iloc[:-1] == 1024).all()


def test_op4_article_text(spark):
    pages = _table("pages").set_index("page_id")
    got = _run(spark, "op4_html")
    assert len(got) == len(pages)
    for r in got.itertuples():
        article = re.search(r"<article>(.*?)(?:</article>|$)", pages["html"][r.page_id], re.S)[1]
        parts = [re.sub(r"</?b>", "", x.replace("<br>", " ")) for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n\n".join(filter(None, (" ".join(html.unescape(x).split()) for x in parts)))
        assert r.text == want and r.n_chars == len(want)


def test_op5_balance(spark, documents):
    got = _run(spark, "op5_sharding")
    assert len(got) == len(documents) and set(got["law"]) == {"rows"}
    sizes = got.groupby("shard")["slot"].agg(["count", "min", "max", "nunique"])
    assert sizes["count"].max() - sizes["count"].min() <= 1 and (sizes["min"] == 0).all()
    assert (sizes["max"] + 1 == sizes["count"]).all() and (sizes["nunique"] == sizes["count"]).all()


def test_op6_files_give_the_ids_back(spark, documents):
    got = _run(spark, "op6_token_files").sort_values("doc_id")
    want = _ids(documents, "word_bpe_49k.json", 1)
    assert list(got["n_tokens"]) == [len(w) for w in want]
    assert list(got["start"]) == [0, *np.cumsum([len(w) for w in want])[:-1]]
    assert list(got["ids_crc32"]) == [zlib.crc32(w.tobytes()) for w in want]


def test_op7_equals_duckdb(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL["op7_decontamination"]).df()
    got = _run(spark, "op7_decontamination")[want.columns.tolist()]
    assert got["contaminated"].any()
    keys = ["doc_id"]
    pd.testing.assert_frame_equal(got.sort_values(keys).reset_index(drop=True),
                                  want.sort_values(keys).reset_index(drop=True))


def test_op8_finds_planted_tokens(spark, documents):
    got = _run(spark, "op8_secrets")
    assert len(got) == len(documents)
    planted = {r.doc_id for r in documents.itertuples() if re.search(r'(?i)token = "[0-9a-f]{40}"', r.text or "")}
    assert set(got[got["n_secrets"] > 0]["doc_id"]) == planted


def test_op9_held_out_accuracy(spark):
    got = queries.op9_quality(spark, "/root/testdata/sf0.01").toPandas()
    labels = ds.dataset("/root/testdata/sf0.01/labels.parquet").to_table().to_pandas()
    held = got[got["held_out"]].merge(labels, on="doc_id")
    assert (held["predicted"] == held["quality"]).mean() > 0.9
    assert ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()


def _components(fps, distance=3):
    """Brute force: smallest index that links of at most ``distance`` bits reach."""
    root = np.arange(len(fps))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= distance):
            a, b = root[i], root[j]
            root[root == max(a, b)] = min(a, b)
    return root


def test_op10_components(spark, documents):
    got = _run(spark, "op10_simhash").sort_values("doc_id")
    fps = np.array([simhash.text_fingerprint(t) for t in documents["text"]], np.uint64)
    assert list(got["fingerprint"]) == [f"{f:016x}" for f in fps]
    assert list(got["component_id"]) == documents["doc_id"].to_numpy()[_components(fps)].tolist()


def test_golay_keys_meet_within_one_bit():
    words = np.random.default_rng(0).integers(0, 1 << 23, 3000)
    keys = golay.keys(words)
    for bit in range(23):
        other = golay.keys(words ^ (1 << bit))
        assert ((other == keys[:, :1]) & (other >= 0)).any(axis=1).all()


@pytest.mark.parametrize("key_block", [50, 20_000])
def test_planted_near_fingerprints_are_linked(spark, key_block):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in base]
    near = base ^ np.array(flips, np.uint64)
    cloud = base[0] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))      # a dense group
    fps = np.unique(np.concatenate([base, near, cloud]))
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    from ledgerlens.llm.components import components
    got = {r["id"]: r["root"] for r in components(simhash.links(df, 3, key_block)).collect()}
    want = _components(fps)
    mine = np.array([got.get(int(f), int(f)) for f in fps.view(np.int64)])
    for root in np.unique(want):
        assert len(set(mine[want == root])) == 1
    assert len(set(mine)) == len(set(want))


def test_fingerprint_by_hand():
    import xxhash
    words = "One two\tTHREE four\x0bfive".lower().split()
    grams = [" ".join(words[i:i + 3]) for i in range(3)]
    bits = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in bits) * 2 > 3)
    assert simhash.text_fingerprint("One two\tTHREE four\x0bfive") == want
    assert simhash.text_fingerprint("Two words") == xxhash.xxh64_intdigest(b"two words", 42)
    assert simhash.text_fingerprint(None) == simhash.text_fingerprint(" \n") == 0


def test_spark_hash_is_the_contracts_hash(spark):
    import xxhash
    text = "ünï çödé words here"
    row = spark.createDataFrame([(text,)], "t string").select(F.xxhash64("t").alias("h")).first()
    assert row["h"] % (1 << 64) == xxhash.xxh64_intdigest(text.encode(), 42)


def test_pipeline_stages(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "SimHash near-dedup", "benchmark decontamination", "secret scans", "packing"]
    from ledgerlens.llm.common import stored
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stored(stage(spark, docs, SF), "test-stage")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        rows = {r.doc_id: r for r in docs.collect()}
        seen = {r.doc_id: r for r in before.collect()}
        assert set(rows) <= set(seen)
        if name == "SimHash near-dedup":
            ids = sorted(seen)
            fps = np.array([simhash.text_fingerprint(seen[i].text) for i in ids], np.uint64)
            assert sorted(rows) == [i for k, i in enumerate(ids) if _components(fps)[k] == k]
        if name == "secret scans":
            assert set(rows) == set(seen)
            for i, r in rows.items():
                assert r.text == re.sub(r'(?i)(token = ")[0-9a-f]{40}(")', r"\1[SECRET]\2", seen[i].text)
                assert r.n_chars == len(r.text)
        else:
            assert all(rows[i] == seen[i] for i in rows)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == docs.count()


def test_pipeline_of_nothing_is_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
