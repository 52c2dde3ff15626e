"""Memory of what runs in the driver and in Python workers."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from ledgerlens.llm import quality, tokens


def test_quality_fit_holds_few_copies_of_the_term_vectors():
    """The fit on the most labelled texts holds about one further copy of their term vectors, and the
    vectors that vote are those of all texts at once."""
    draw = np.random.default_rng(1)
    terms = np.zeros((3000, quality.TERMS + 1), np.float32)
    rows = np.repeat(np.arange(3000), 200)
    terms[rows, draw.integers(0, quality.TERMS, len(rows))] = 1
    labels = draw.integers(0, 2, len(terms)).astype(float)
    tracemalloc.start()
    model = quality.fit_terms(terms, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * terms.nbytes
    assert np.array_equal(model.vectors, model.latent(terms))


def traced(call):
    tracemalloc.start()
    try:
        out = call()
        return tracemalloc.get_traced_memory()[1], out
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("distinct", [2_000, 400_000])
def test_encoder_holds_few_times_the_bytes_of_a_slice(distinct):
    """Ids of many short words, and of many new words with closing marks, are made in blocks."""
    draw = np.random.default_rng(2)
    words = np.array([np.base_repr(i, 36).lower().translate(str.maketrans("0123456789", "qwrtpsdfgh")) for i in range(distinct)])
    texts = [" ".join(words[draw.integers(0, distinct, 1000)]) + "." for _ in range(1500)] + [" ".join(w + "!" for w in words)]
    enc = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    peak, found = traced(lambda: [ids[a:b] for _, ids, ends in enc.encode(pa.array(texts)) for a, b in zip(ends, ends[1:])])
    assert len(found) == len(texts)
    for i in (0, 700, 1499):
        assert found[i].tolist() == enc.tokenizer.encode(texts[i], add_special_tokens=False).ids
    assert peak < 9 * min(sum(map(len, texts)), 8 << 20)


def test_a_task_leaves_few_pieces_in_the_worker():
    """Workers live on beside the other stages of an executor: of what a task learned, they keep the
    pieces that its last slice repeats."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = pa.array([" ".join(f"word{i}" for i in range(2000)), "word7 word7 and word8,", None, "two\r\nlines"])
    whole = [tokens.encoder(path).tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
    for _ in range(2):
        with tokens.task_encoder(path) as enc:
            found = [ids[a:b].tolist() for _, ids, ends in enc.encode(texts) for a, b in zip(ends, ends[1:])]
            assert len(enc._lens) > 2000
        assert found == whole
        assert 0 < len(enc._lens) < 20
        assert len(enc._flat) == enc._lens.sum()


def test_a_memo_that_was_cut_back_within_a_slice_keeps_its_common_pieces(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_ENTRIES", 3)
    enc = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("one two, three four five five", "six seven one one two,", ""):
        (_, ids, _), = enc.encode(pa.array([text]))
        assert ids.tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
    list(enc.encode(pa.array(["eight ten nine ten nine"])))
    enc.keep_common()
    assert sorted(enc._pieces.to_pylist()) == ["nine", "ten"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_new_pieces_go_to_the_tokenizer_by_many(name):
    """New pieces are encoded by many in one text, with the ids that each has alone, whatever they hold."""
    enc, plain, seen = tokens.Encoder(public_tokenizers.path(name)), tokens.Encoder(public_tokenizers.path(name)).tokenizer, []
    raw = enc._raw
    enc._raw = lambda texts: seen.append(len(texts)) or raw(texts)
    texts = [" ".join(f"word{i}x" for i in range(4000))]
    for odd in ("\x01", "a\x01b \x01 c", "\x01\x01 \x01", "one\n\ntwo\n", "\nline start's it'll", "a᠎ b᠎", "tab\tin \t word",
                " x y z", "x́ ́y é.", "\x1c \x85  ", "ends.,; ;. ...!?", "  two  spaces ", "",
                "<|endoftext|> a<|endoftext|>", "ÉTÉ! İx, ΣΣ. 中文!", "​ ​z", "\U0001f600 \U0001f600!!", "\x00 a\x00"):
        texts += [odd, f"before{len(texts)} {odd} behind{len(texts)}."]
    found = [ids[a:b].tolist() for _, ids, ends in enc.encode(pa.array(texts)) for a, b in zip(ends, ends[1:])]
    assert found == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert sum(seen) < 600
