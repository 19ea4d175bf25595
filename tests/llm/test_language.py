import zlib

import numpy as np
import pytest
from cases import empty, odd, odd_rows, plain

from tidemark.llm import bytecnn
from tidemark.llm.bytecnn import ByteNetwork, gradients, letter_bytes, train, windows_of
from tidemark.llm.language import (
    LETTER,
    UNKNOWN,
    WINDOWS_PER_TEXT,
    fit_language,
    held_out,
    predict_language,
    training_windows,
)
from tidemark.llm.queries import op12_byte_network

FOLDER = "/root/testdata/sf0.01"
LABELLED = "doc_id bigint, text string, lang string"


@pytest.fixture(scope="module")
def net(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return fit_language(docs, ~held_out(docs["doc_id"]))


def slow_probabilities(net: ByteNetwork, window: bytes) -> np.ndarray:
    """Every filter at every place by its own loop."""
    data = list(window.ljust(bytecnn.WINDOW + bytecnn.SPAN - 1, b"\0"))
    pooled = []
    for f in range(net.filters.shape[1]):
        width = bytecnn.WIDTHS[f // bytecnn.FILTERS]
        at = []
        for p in range(bytecnn.WINDOW):
            at.append(sum(float(net.embedding[data[p + k]] @ net.filters[k * bytecnn.EMBEDDED:(k + 1) * bytecnn.EMBEDDED, f])
                          for k in range(width)))
        pooled.append(max(0.0, max(at) + float(net.bias[f])))
    scores = np.array(pooled) @ net.output + net.shift
    return np.exp(scores - scores.max()) / np.exp(scores - scores.max()).sum()


def slow(net, text):
    """(language, score) of a text, window by window."""
    if text is None or not any(c.isalpha() for c in text):
        return UNKNOWN, 0.0
    data, total = text.encode(), 0.0
    for lo in range(0, len(data), bytecnn.WINDOW):
        part = data[lo:lo + bytecnn.WINDOW]
        letters = sum(chr(b).isascii() and chr(b).isalpha() or b >= 0x80 for b in part)
        if letters:
            total = total + letters * slow_probabilities(net, part)
    return net.labels[int(np.argmax(total))], float(total.max() / total.sum())


def test_held_out_accuracy(spark, net):
    want = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = op12_byte_network(spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(want)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    unseen = [r for r in rows if r["held_out"] and any(c.isalpha() for c in want[r["doc_id"]][1])]
    right = [r["lang_pred"] == want[r["doc_id"]][0] for r in unseen]
    assert len(right) > 200 and np.mean(right) > 0.99
    for lang in net.labels:
        mine = [ok for r, ok in zip(unseen, right) if want[r["doc_id"]][0] == lang]
        assert np.mean(mine) > 0.95, lang


def test_short_texts(spark, net):
    every = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = every.where(held_out(every["doc_id"])).collect()
    rows = [(i, " ".join((r["text"] or "").split()[10:20]), r["lang"]) for i, r in enumerate(docs)]
    rows = [r for r in rows if len(r[1]) > 30]
    got = {r["doc_id"]: r["lang_pred"] for r in predict_language(plain(spark, rows, LABELLED), net).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.9


def test_like_slow_network(spark, net):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("n_chars < 700").limit(12)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in predict_language(docs, net).collect():
        lang, score = slow(net, texts[r["doc_id"]])
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-4)


def test_whole_texts_count(spark, net):
    """What most of a long text says decides, not how it begins; batches do not matter."""
    by_lang = {}
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").where("n_chars > 3000").collect():
        by_lang.setdefault(r["lang"], r["text"])
    rows = [(1, by_lang["en"][:3000] + " " + by_lang["de"] * 200), (2, by_lang["fr"]), (3, by_lang["es"][:600] + by_lang["fr"] * 30)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict_language(plain(spark, rows), net).collect()}
    assert [got[i][0] for i in (1, 2, 3)] == ["de", "fr", "fr"]
    alone = predict_language(plain(spark, rows[:1]), net).first()
    assert got[1][1] == pytest.approx(alone["score"], abs=1e-6)


def test_gradients():
    """Against finite differences of the loss, in every part of the network."""
    source = np.random.default_rng(5)
    windows = source.integers(1, 255, (20, bytecnn.WINDOW)).astype(np.uint8)
    target, weight = np.arange(20) % 3, source.random(20) + 0.1
    net = train(windows, target, weight, ["a", "b", "c"], epochs=1)
    for name in ("embedding", "filters", "bias", "output", "shift"):
        setattr(net, name, getattr(net, name).astype(np.float64))

    def loss():
        hidden = np.maximum(net._pooled(windows) + net.bias, 0)
        found = bytecnn.softmax(hidden @ net.output + net.shift)
        return float(-(weight * np.log(found[np.arange(20), target])).sum())

    slopes = gradients(net, windows, target, weight)
    for name, slope in zip(("embedding", "filters", "bias", "output", "shift"), slopes):
        flat, flat_slope = getattr(net, name).reshape(-1), np.asarray(slope).reshape(-1)
        for i in np.argsort(-np.abs(flat_slope))[:6]:
            kept = flat[i]
            flat[i] = kept + 1e-6
            high = loss()
            flat[i] = kept - 1e-6
            assert (high - loss()) / 2e-6 == pytest.approx(flat_slope[i], rel=2e-3, abs=1e-5), name
            flat[i] = kept


def test_training_lowers_the_loss():
    source = np.random.default_rng(6)
    windows = source.integers(1, 255, (400, bytecnn.WINDOW)).astype(np.uint8)
    windows[:200] = windows[:200] % 40 + 60
    target, weight = np.repeat([0, 1], 200), np.ones(400)
    nets = [train(windows, target, weight, ["a", "b"], epochs=n) for n in (1, 24)]
    losses = [-np.log(net.probabilities(windows)[np.arange(400), target]).mean() for net in nets]
    assert losses[0] > losses[1] and losses[1] < 0.05
    again = train(windows, target, weight, ["a", "b"], epochs=24)
    assert (again.filters == nets[1].filters).all()


def test_sample_is_bounded_and_repeats_count_once(spark):
    """A text that is a third of all rows, and a language with few texts."""
    rows = [(i, "one text that is repeated very often here", "en") for i in range(600)]
    rows += [(i, f"ein anderer Text mit der Nummer {i}", "de") for i in range(1000, 2200)]
    rows += [(5000, "seul texte", "fr"), (5001, None, "fr"), (5002, "12 34", "es"), (5003, "no language", None)]
    got = training_windows(plain(spark, rows, LABELLED), None, 50).collect()
    counts = {}
    for r in got:
        counts[r["lang"]] = counts.get(r["lang"], 0) + 1
        assert len(r["cuts"]) == WINDOWS_PER_TEXT
    assert counts == {"en": 1, "de": 50, "fr": 1}


def test_odd_rows(spark, net):
    want = sorted(((i, *slow(net, t)) for i, t, *_ in odd_rows() if len(t or "") < 2000), key=repr)
    got = [tuple(r) for r in predict_language(odd(spark), net).collect()]
    assert len(got) == len(odd_rows())
    short = sorted((r for r in got if r[0] not in (6, 7, 8)), key=repr)
    assert [(i, lang) for i, lang, _ in short] == [(i, lang) for i, lang, _ in want]
    assert all(0 <= r[2] <= 1 for r in got)
    rows = [(1, "²½ 12 _"), (2, "日本"), (3, "é")]
    langs = {r["doc_id"]: r["lang_pred"] for r in predict_language(plain(spark, rows), net).collect()}
    assert langs[1] == UNKNOWN and langs[2] in net.labels and langs[3] in net.labels and LETTER.search("é")


def test_nothing_to_learn_from(spark, net):
    none = fit_language(plain(spark, [(1, "text", None), (2, None, "en"), (3, "!?", "en")], LABELLED))
    assert none is None
    assert [tuple(r) for r in predict_language(plain(spark, [(1, "text")]), none).collect()] == [(1, UNKNOWN, 0.0)]
    assert predict_language(empty(spark), net).collect() == []
    assert fit_language(plain(spark, [], LABELLED)) is None
    one = fit_language(plain(spark, [(1, "only one language here", "en")], LABELLED))
    assert predict_language(plain(spark, [(1, "what")]), one).first()["lang_pred"] == "en"


def test_windows():
    data = "é" * 300
    got = windows_of(data.encode())
    assert got.tobytes().rstrip(b"\0") == data.encode() and got.shape == (3, bytecnn.WINDOW)
    assert letter_bytes(windows_of(b"a1 Z")).tolist() == [2] and windows_of(b"").shape == (0, bytecnn.WINDOW)
