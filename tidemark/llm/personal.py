"""Personal data: fixed patterns, and a trained tagger that adds what they miss."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hash_sample, texts
from tidemark.llm.tagger import KINDS, Tagger, char_classes, train

# Code points of a window and the distance of window starts. A window speaks for its
# middle; spans that cross into a neighbour's are joined, whatever their length.
WIDTH, STRIDE = 96, 48
# Bounds of the training: documents looked at, windows learnt from.
SAMPLE_DOCUMENTS, SAMPLE_WINDOWS = 8000, 3000
# Least mean probability of the labels of a span that the tagger adds.
SURE = 0.8
# Windows decoded at once.
DECODED = 2048

Span = tuple[str, int, int]

# Fixed patterns of the base, with possessive repeats where that changes no match.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
# How an email writes its sign, and what any span has: no kind is plausible without it.
_SIGNS = r"@|\(at\)|\[at\]"
TRIGGER = re.compile(rf"[0-9]|{_SIGNS}")
_EMAIL = re.compile(rf"[^\s@]+ ?(?:{_SIGNS}) ?[^\s@]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append(("email", start, end))
            at = text.find("@", end)
        else:
            end = at + 1  # no local part reaches over this sign
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns: leftmost without overlap for each kind, failing ones dropped."""
    out = _emails(text)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = "".join(_DIGITS.findall(m.group()))
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.findall(m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def _plausible(kind: str, text: str) -> bool:
    """What a span that the tagger adds must have: the digits or the sign of its kind."""
    digits = "".join(_DIGITS.findall(text))
    if kind == "email":
        return bool(_EMAIL.fullmatch(text)) and len(text) >= 6
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not re.search(r"[A-Za-z]", text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9 ./_-]", text)
    return 9 <= len(digits) <= 15 and not re.search(r"[^0-9 ()./+-]", text) and bool(re.search(r"[ ()./-]", text))


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold the start of a trigger; every span has one."""
    wanted = set()
    for m in TRIGGER.finditer(text):
        k = m.start() // STRIDE
        wanted |= {k, k - 1}
    return sorted(k * STRIDE for k in wanted if k >= 0)


def _labels(spans: list[Span], start: int) -> np.ndarray:
    out = np.zeros(WIDTH, dtype=np.int64)
    for kind, a, b in spans:
        a, b = a - start, b - start
        if a < WIDTH and b > 0:  # a cut span keeps the labels of its part
            code = 1 + 2 * KINDS.index(kind)
            out[max(a, 0):b] = code + 1
            if a >= 0:
                out[a] = code
    return out


_ALTERED_SIGNS = (" @ ", "(at)", "[at]", " (at) ", " [at] ")


def _spelled(words: list[str], source: random.Random) -> str:
    """An altered email of words without digits, short or long."""
    local = source.choice("._-").join(source.choices(words, k=source.randrange(1, 6)))
    site = ".".join(source.choices(words, k=source.randrange(1, 4)))
    return local + source.choice(_ALTERED_SIGNS) + site + source.choice([".com", ".org", ".net", ".edu"])


def _altered(kind: str, text: str, source: random.Random) -> str:
    """A way to write a span that the fixed patterns do not know."""
    if kind == "email":
        return text.replace("@", source.choice(_ALTERED_SIGNS))
    if kind == "ip":
        return text.replace(".", source.choice(["[.]", ". ", "-"]))
    digits = "".join(_DIGITS.findall(text))
    if kind == "card":
        return source.choice([".", "/", "_"]).join(digits[i:i + 4] for i in range(0, len(digits), 4))
    body = digits[-10:]
    return source.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}", "1-{}-{}-{}", "001 {} {} {}"]).format(
        body[:-7], body[-7:-4], body[-4:])


def _training_windows(text: str, seed: int) -> list[tuple[str, list[int]]]:
    """Labelled windows of a text: as found, altered, and without a span."""
    source = random.Random(seed)
    spans = sorted(base_spans(text), key=lambda s: s[1])
    spans = [s for i, s in enumerate(spans) if not i or s[1] >= spans[i - 1][2]]
    words = re.findall(r"[a-z]{2,12}", text[:4096].lower())
    out = []
    for kind, a, b in spans[:2]:
        ways = [text[a:b], *(_altered(kind, text[a:b], source) for _ in range(3))]
        if kind == "email" and words:
            ways += [_spelled(words, source) for _ in range(4)]
        for changed in ways:
            room = WIDTH - len(changed)
            low = max(0, a - source.randrange(room + 1)) if room >= 0 else a + source.randrange(1 - room)
            window = (text[low:a] + changed + text[b:b + WIDTH])[max(0, low - a):][:WIDTH]
            shift = len(changed) - (b - a)
            marks = [(kind, a, a + len(changed))] + [(k, x + shift, y + shift) for k, x, y in spans if x >= b]
            marks += [(k, x, y) for k, x, y in spans if y <= a]
            out.append((window, _labels(marks, low).tolist()))
    free = [w for w in window_starts(text) if not any(a < w + WIDTH and b > w for _, a, b in spans)]
    for w in free[:2]:
        out.append((text[w:w + WIDTH], [0] * WIDTH))
        if words and spans:  # a sign between words is no email yet
            cut = source.randrange(WIDTH)
            sign = source.choice(_ALTERED_SIGNS[1:])
            out.append(((text[w:w + cut] + sign + text[w + cut:w + WIDTH].lstrip(". "))[:WIDTH], [0] * WIDTH))
    return out


def fit_tagger(docs: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS,
               sample_windows: int = SAMPLE_WINDOWS) -> Tagger | None:
    """Train the tagger on labelled spans of a bounded sample.

    About ``sample_documents`` documents are chosen by a hash; their spans of the
    fixed patterns are the labels, as they stand and rewritten in ways that the
    patterns do not know; windows with digits but no span teach what to leave.
    At most ``sample_windows`` windows reach the driver. None if there are none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [w for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                    for w in _training_windows(text, len(text) + 31 * (doc_id or 0))]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()),
                                              pa.array([m for _, m in rows], pa.list_(pa.int32()))], ["window", "marks"])

    found = hash_sample(texts(docs), sample_documents).mapInArrow(run, "window string, marks array<int>")
    rows = sorted((r["window"], tuple(r["marks"])) for r in
                  found.orderBy(F.xxhash64("window"), "window", "marks").limit(sample_windows).collect())
    if not any(any(m) for _, m in rows):
        return None
    cls = np.stack([char_classes(w, WIDTH) for w, _ in rows])
    return train(cls, np.array([m for _, m in rows], dtype=np.int64))


def _reconcile(candidates: dict[Span, float]) -> list[Span]:
    """The spans without overlap whose scores sum to the most, over a whole text."""
    spans = sorted(candidates, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in spans]
    best, take = [0.0], []
    for i, (_, a, _) in enumerate(spans):
        before = int(np.searchsorted(ends[:i], a, side="right"))
        value = best[before] + candidates[spans[i]]
        take.append((value > best[i], before))
        best.append(max(best[i], value))
    out, i = [], len(spans)
    while i:
        taken, before = take[i - 1]
        if taken:
            out.append(spans[i - 1])
        i = before if taken else i - 1
    return out


def _pieces(marks: np.ndarray, shares: np.ndarray, at: int) -> list[list]:
    """[kind, start, end, sum of probabilities, begun] of the labelled runs of a stretch from ``at``."""
    out: list[list] = []
    for t in np.nonzero(marks)[0].tolist():
        kind, begun = divmod(int(marks[t]) - 1, 2)
        if out and begun and out[-1][0] == kind and out[-1][2] == at + t:
            out[-1][2] += 1
            out[-1][3] += float(shares[t])
        else:
            out.append([kind, at + t, at + t + 1, float(shares[t]), not begun])
    return out


def _joined(pieces: list[list]) -> list[list]:
    """Spans made of two or more pieces of neighbouring windows."""
    out: list[list] = []
    for kind, a, b, total, begun in sorted(pieces, key=lambda p: p[1]):
        if out and not begun and out[-1][0] == kind and out[-1][2] == a:
            out[-1][2:] = [b, out[-1][3] + total, out[-1][4] + 1]
        else:
            out.append([kind, a, b, total, 1])
    return [s for s in out if s[4] > 1]


def added_spans(rows: list[str], base: list[list[Span]], model: Tagger | None) -> list[list[Span]]:
    """What the tagger adds to each text's base spans.

    All windows with a trigger are decoded, and their neighbours as far as a span
    goes on in them. Candidates are the spans inside a window, and those joined from
    the middles of neighbouring windows, so no length is too long. Candidates of all
    windows of a text are weighed against each other; spans that meet a base span,
    are unsure or lack what their kind needs go.
    """
    out: list[list[Span]] = [[] for _ in rows]
    if model is None:
        return out
    places = [(i, w) for i, text in enumerate(rows) for w in window_starts(text)]
    known = set(places)
    candidates: list[dict[Span, float]] = [{} for _ in rows]
    pieces: list[list[list]] = [[] for _ in rows]

    def weigh(i: int, label: int, start: int, end: int, score: float) -> None:
        key = (KINDS[label], start, end)
        if score >= SURE and _plausible(key[0], rows[i][start:end]):
            candidates[i][key] = max(score, candidates[i].get(key, 0.0))

    edge = (WIDTH - STRIDE) // 2
    while places:
        wanted = set()
        for lo in range(0, len(places), DECODED):
            part = places[lo:lo + DECODED]
            cls = np.stack([char_classes(rows[i][w:w + WIDTH], WIDTH) for i, w in part])
            labels, sure = model.decode(cls.T)
            for (i, w), marks, shares in zip(part, labels, sure):
                size = len(rows[i])
                for a in np.nonzero(marks % 2 == 1)[0].tolist():
                    b = a + 1
                    while b < WIDTH and marks[b] == marks[a] + 1:
                        b += 1
                    start, end = w + a, min(w + b, size)
                    if start >= size or (a == 0 and w) or (b == WIDTH and end < size):
                        continue
                    weigh(i, (int(marks[a]) - 1) // 2, start, end, float(shares[a:b].mean()))
                first, last = w + edge if w else 0, min(w + edge + STRIDE, size)
                if first >= last or not marks[first - w:last - w].any():
                    continue
                found = _pieces(marks[first - w:last - w], shares[first - w:last - w], first)
                if w and found[0][1] == first and not found[0][4]:
                    wanted.add((i, w - STRIDE))
                if found[-1][2] == last < size:
                    wanted.add((i, w + STRIDE))
                pieces[i] += found
        places = sorted(p for p in wanted - known if p[1] < len(rows[p[0]]))
        known.update(places)
    for i, found in enumerate(candidates):
        for label, start, end, total, _ in _joined(pieces[i]):
            weigh(i, label, start, end, total / (end - start))
        free = {s: v for s, v in found.items() if not any(s[1] < b and a < s[2] for _, a, b in base[i])}
        out[i] = _reconcile(free) if free else []
    return out


def in_order(spans: list[Span]) -> str:
    """kind:start:end by kind as listed, then by start, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


_FOUND = ("doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, "
          "spans string, n_added bigint")


def personal_data(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """Personal data of every row: counts and digest of the base, all spans, number added.

    Offsets count code points, ends are exclusive. The counts are those of the fixed
    patterns. Null texts are empty and have no spans; null ids and repeated rows are
    kept; other columns are ignored. Whole texts, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("text").to_pylist()
            base = [base_spans(t) for t in rows]
            more = added_spans(rows, base, model)
            counts = [pa.array([sum(1 for s in b if s[0] == k) for b in base], pa.int64()) for k in KINDS]
            marks = [hashlib.sha256(in_order(b).encode("utf-8")).hexdigest() for b in base]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(marks, pa.string()),
                 pa.array([in_order(b + m) for b, m in zip(base, more)], pa.string()),
                 pa.array([len(m) for m in more], pa.int64())], [f.split()[0] for f in _FOUND.split(", ")])

    return texts(docs).mapInArrow(run, _FOUND)
