"""Byte-level BPE against the library."""

import hashlib
import random

import numpy as np
import pytest

from strandcall.llm import pair_index
from strandcall.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")
END = "<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def bpe():
    return pair_index.ByteBpe(PATH)


def odd_strings():
    rng = random.Random(1)
    texts = ["", " ", END, f"a{END} {END}  b", "<|endoftext|", "a" * 5000, "aab" * 3000, " " * 3001, "it's we'll I'D 's", "\r\n\t x", "漢字" * 900]
    texts += ["\u0558 x \u088f", "\x00\x01\x1c\x1d a", "😀😀 😀", "\u3000 \u2003a\u00a0b", "é\u0301" * 500, "!" * 999 + "1" * 999]
    letters = ["a", "b", " ", "é", "漢", "1", "'", "s", "\n", "!", "\u0558", END]
    texts += ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(800)]
    return texts + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x3000), 0x1F600])) for _ in range(60)) for _ in range(300)]


def same(bpe, library, texts):
    found = bpe.encode(texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [f.tolist() for f in found] == want
    assert [bpe.decode(f.tolist()) for f in found] == [library.decode(w, skip_special_tokens=False) for w in want]


@pytest.mark.parametrize("piece", [1 << 20, 40])
def test_ids_are_those_of_the_library(bpe, library, monkeypatch, piece):
    monkeypatch.setattr(pair_index, "PIECE", piece)
    same(bpe, library, odd_strings())


def test_words_are_forgotten_without_a_change(bpe, library, monkeypatch):
    monkeypatch.setattr(pair_index, "KNOWN", 0)
    texts = odd_strings()[:60]
    for k in range(0, 60, 7):
        same(bpe, library, texts[k : k + 7])


def test_any_ids_are_decoded(bpe, library):
    rng = np.random.default_rng(2)
    for _ in range(50):
        ids = rng.integers(0, 50257, 40).tolist()
        assert bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_a_rank_must_not_come_back():
    """abc as ab + c before a + b gives ab has no order that batches could keep."""
    with pytest.raises(ValueError, match="later"):
        pair_index.PairIndex(np.arange(3), np.array([[3, 2], [0, 1]]), np.array([4, 3]), 5)


@pytest.mark.parametrize("where", ["given", "odd"])
def test_op11(spark, odd_dir, library, where):
    folder = SF_DIR if where == "given" else odd_dir
    want = []
    for d in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False).encode()
        want.append((d.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest()))
    found = [tuple(r) for r in QUERIES["op11_pair_index"](spark, folder).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_stored_ids_are_decoded(spark, odd_docs):
    """Ids written and read again give the texts, nulls as empty ones."""
    encoded = pair_index.encode(odd_docs)
    alone = pair_index.decode(encoded).collect()
    assert sorted(map(repr, alone)) == sorted(map(repr, pair_index.encode(odd_docs, decoded=True).collect()))
    assert sorted((r.doc_id or -1, r.text) for r in alone) == sorted((r.doc_id or -1, r.text or "") for r in odd_docs.collect())
