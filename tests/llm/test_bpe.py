import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from cases import empty, odd, odd_rows, plain, small_docs
from tokenizers import Tokenizer

from tidemark.llm import bpe
from tidemark.llm.bpe import Encoder, encode_documents, join_tree, token_digests

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def slow(library, rows):
    out = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        out.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                    hashlib.sha256(decoded.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_trees_give_the_whole_encoding(library):
    source = random.Random(4)
    encoder = Encoder(PATH)
    kinds = ["abcdefgh", "aAbB'stlrevmd ", "!?.,'s ", "0123 ab", "日本語é é́", "<|endoftext|> ", "x", "İß \x1c\x85ab"]
    for trial in range(150):
        alphabet = source.choice(kinds) if trial % 3 else "".join(kinds)
        text = "".join(source.choice(alphabet) for _ in range(source.randrange(1, 600)))
        if trial % 7 == 0:
            text = text.replace("a", "<|endoftext|>")
        leaf = source.choice([1, 3, 17, 64])
        nodes = [encoder.units(text[i:i + leaf], i) for i in range(0, len(text), leaf)]
        whole = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert join_tree(nodes, text, encoder) == whole, (text, leaf)
        assert encoder.encode(text) == whole


def test_matches_the_library(spark, library):
    rows = small_docs()
    found = token_digests(plain(spark, rows), PATH, leaf=2000)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == slow(library, rows)


def test_odd_rows(spark, library):
    rows = [(r[0], r[1]) for r in odd_rows()]
    for leaf in (500, 1 << 20):
        found = token_digests(odd(spark), PATH, leaf=leaf)
        assert sorted((tuple(r) for r in found.collect()), key=repr) == slow(library, rows)
    assert token_digests(empty(spark), PATH).count() == 0
    ids = encode_documents(plain(spark, [(1, "Hello"), (2, None)]), PATH).orderBy("doc_id").collect()
    assert ids[0]["ids"] == library.encode("Hello", add_special_tokens=False).ids and ids[1]["ids"] == []


def test_new_chunks_share_one_call(library, monkeypatch):
    """Chunks not met before are encoded together, once; a full memory keeps what was met last."""
    calls = []

    class Counted:
        def __getattr__(self, name):
            return getattr(library, name)

        def encode(self, text, **more):
            calls.append(text)
            return library.encode(text, **more)

        def encode_batch_fast(self, rows, **more):
            calls.extend(rows)
            return library.encode_batch_fast(rows, **more)

    encoder = Encoder(PATH)
    encoder.library = Counted()
    chunks = ["Hello,", "éá", "<|endoftext|>x", "́b", "İß", "日本語", "Hello,", "it's", "​", "y" * 70]
    want = [np.array(library.encode(c, add_special_tokens=False).ids, "<u4").tobytes() for c in chunks]
    assert encoder.chunks(chunks) == want and len(calls) == 1
    assert encoder.chunks(chunks[:9]) == want[:9] and len(calls) == 1
    monkeypatch.setattr(bpe, "REMEMBERED", 8)
    assert encoder.chunks(["new"]) == encoder.chunks(["new"]) and len(calls) == 2
    assert encoder.chunks(chunks[:9]) == want[:9] and len(calls) == 2
    whole = library.encode(" ".join(chunks), add_special_tokens=False).ids
    assert encoder.decode(b"".join(want)) == library.decode(whole, skip_special_tokens=False)
