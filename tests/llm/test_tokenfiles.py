import zlib

import numpy as np
import public_tokenizers
from cases import empty, odd, odd_rows, plain, small_docs
from tokenizers import Tokenizer

from tidemark.llm.tokenfiles import ByteEncoder, lookup, read_tokens, round_trip, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def slow(rows):
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len(ids_of(r[1])))):
        ids = [*ids_of(text), 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=repr)


def test_chunks_give_the_whole_encoding():
    encoder = ByteEncoder(PATH)
    for text in ["", " ", "  a", "a  b", "a \n b", "a\n\n\nb ", "don't  stop'll \t x", "\x1c a \x85\xa0b", "a <|endoftext|> b",
                 "a  <|endoftext|>", "日本 語\u3000x", "\u2028\u2029 y", "1 22  333", "!? ...", "tab\tend\t"]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids_of(text), repr(text)


def test_round_trip(spark):
    rows = small_docs()
    found = round_trip(plain(spark, rows).repartition(3), PATH)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == slow(rows)


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_rows() if r[0] not in (None, 5)]  # ties follow by content
    found = round_trip(odd(spark).where("doc_id <> 5"), PATH)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == slow(rows)
    every = round_trip(odd(spark), PATH)
    assert every.count() == len(odd_rows())
    starts = sorted((r["start"], r["n_tokens"]) for r in every.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0
    assert round_trip(empty(spark), PATH).count() == 0


def test_lookup_reads_single_documents(spark, tmp_path):
    rows = small_docs()
    write_tokens(plain(spark, rows), PATH, str(tmp_path))
    wanted = dict(rows[5:8])
    found = {r["doc_id"]: r["ids"] for r in lookup(spark, str(tmp_path), list(wanted)).collect()}
    assert found == {i: [*ids_of(t), 0] for i, t in wanted.items()}
    assert read_tokens(spark, str(tmp_path)).count() == len(rows)
