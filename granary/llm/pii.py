"""Personal data: patterns, and a skip-chain conditional random field that carries labels to repeated or similar tokens."""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, words
from .tokens import _LOWER

KINDS = ("email", "ip", "card", "phone")
#: Documents that the field is fitted on at most, of different texts, and the tokens of each that count.
SAMPLE, SAMPLE_TOKENS = 4000, 2000
#: A token is labelled where its marginal probability reaches this.
SURE = 0.65
#: How many of the texts' own tokens the field is fitted on for each value added to them, about.
OWN_SHARE = 3
#: Messages have settled when none changes by this much. A field of attracting pairs settles in a few rounds; after UNDAMPED
#: rounds messages are damped, and ROUNDS only ends what would oscillate for ever.
SETTLED, UNDAMPED, ROUNDS = 1e-5, 20, 1000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_EDGE = " \t\r\n.,;:!?()[]{}\"'<>#&%$*=|"
_MARK = np.zeros(256, bool)
_MARK[[0x40, *range(0x30, 0x3A)]] = True


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each at-sign's longest run of local characters after the last match; no start inside a run could do better."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > done and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at) if s < at else None
        if m:
            out.append((s, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """The spans that the patterns find, by kind; leftmost, not overlapping within a kind."""
    found: list[list[tuple[int, int]]] = [emails(text), [], [], []]
    if "." in text:
        found[1] = [m.span() for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found[2].append(m.span())
    if "+" in text:
        found[3] = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


def written(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, own in zip(KINDS, spans) for s, e in sorted(own))


class Tokens(NamedTuple):
    """The white-space words of one text that hold a digit, an at-sign or the local part of an email found in it; all other
    words are outside any entity."""

    first: np.ndarray  # code points
    last: np.ndarray
    number: np.ndarray  # of the word in its text
    spelled: list[str]
    before: list[str]  # the word before, in lower case
    keys: list[set[str]]  # what repeats and similar tokens share


FEATURES = ("bias", "at", "dot_after_at", "plus", "dots3", "dash", "paren", "letters", "digits_1_4", "digits_5_8", "digits_9_12", "digits_13_19", "digits_20", "luhn", "all_digits", "octets", "hex", "colon", "cue_phone", "cue_mail", "cue_card", "cue_ip", "near_before", "near_after")
_CUES = ({"tel", "phone", "call", "mobile", "fax"}, {"mail", "email", "e-mail", "contact"}, {"card", "visa", "iban", "pay"}, {"ip", "host", "server", "address"})


def features(t: Tokens) -> np.ndarray:
    out = np.zeros((len(t.spelled), len(FEATURES)), np.float32)
    for i, (w, p) in enumerate(zip(t.spelled, t.before)):
        digits = re.sub(r"[^0-9]", "", w)
        n, at = len(digits), w.find("@")
        core = w.strip(_EDGE)
        cue = p.strip(_EDGE)
        out[i] = (
            1, at >= 0, at >= 0 and "." in w[at:], w.startswith("+"), core.count(".") == 3, "-" in core, "(" in w or ")" in w, any(c.isalpha() for c in w),
            1 <= n <= 4, 5 <= n <= 8, 9 <= n <= 12, 13 <= n <= 19, n >= 20, 13 <= n <= 19 and luhn(digits), core.isdigit(),
            core.count(".") == 3 and all(x.isdigit() and len(x) < 4 and int(x) <= 255 for x in core.split(".")), len(core) >= 16 and re.fullmatch("[0-9a-f]+", core) is not None, ":" in core,
            cue in _CUES[0], cue in _CUES[1], cue in _CUES[2], cue in _CUES[3], 0, 0,
        )
    near = np.diff(t.number) == 1
    out[1:, -2] = near
    out[:-1, -1] = near
    return out


def canonical(w: str) -> str:
    return re.sub(r"[^0-9a-z]+", "-", w.lower()).strip("-")


def likeness(w: str) -> set[str]:
    """What tokens that repeat or resemble a word, or a span of words, share with it: letters and digits but for the signs
    between them, and the last seven digits."""
    digits = re.sub(r"[^0-9]", "", w)
    return {"=" + canonical(w)} | ({"~" + digits[-7:]} if len(digits) >= 7 else set())


def local_parts(text: str, emails_: list[tuple[int, int]]) -> set[str]:
    """The local parts of emails that no plain word is likely to be: six signs or more, not all of them letters."""
    return {p for s, e in emails_ if len(p := text[s:e].partition("@")[0].lower()) >= 6 and not p.isalpha()}


def edges(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Chain edges between neighbouring words, and skip edges from each token to the next that shares a key with it.

    Each links to the next one only, so there are few skip edges for each token, however often it repeats.
    """
    chain = np.flatnonzero(np.diff(t.number) == 1)
    skip: set[tuple[int, int]] = set()
    seen: dict[str, int] = {}
    for i, own in enumerate(t.keys):
        for key in own:
            if key in seen:
                skip.add((seen[key], i))
            seen[key] = i
    return np.stack([chain, chain + 1], 1).astype(np.int64), np.array(sorted(skip), np.int64).reshape(-1, 2)


def anchored(t: Tokens, base: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """The skip edges, and one from each token that no pattern labelled to the last alike one before it that a pattern
    did, or else the first after it: what is observed reaches every repeat by itself, however many lie between."""
    found = {(a, b) for a, b in skip.tolist()}
    if not base.any():
        return skip
    missing = set()
    for order in (range(len(base)), range(len(base) - 1, -1, -1)):
        seen: dict[str, int] = {}
        for i in order:
            for key in t.keys[i]:
                if base[i]:
                    seen[key] = i
                elif key in seen and (order.step > 0 or (i, key) in missing):
                    found.add((min(i, seen[key]), max(i, seen[key])))
                elif order.step > 0:
                    missing.add((i, key))
    return np.array(sorted(found), np.int64).reshape(-1, 2)


def tokens_of(text: str, spans: list[list[tuple[int, int]]], data: np.ndarray, first: np.ndarray, last: np.ndarray, marked: np.ndarray) -> Tokens:
    """The marked words of a text from the byte spans of all its words, and those that hold a local part of its emails."""
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    locals_ = local_parts(text, spans[0])
    if locals_:
        marked, low = marked.copy(), _LOWER[data].tobytes()
        for p in locals_:
            at = low.find(p.encode())
            while at >= 0:
                marked[np.searchsorted(last, at, side="right")] = True
                at = low.find(p.encode(), at + len(p))
    at = np.flatnonzero(marked)
    s, e = points[first[at]], points[last[at]]
    b = np.maximum(at - 1, 0)
    before = [text[x:y].lower() if i else "" for i, x, y in zip(at.tolist(), points[first[b]].tolist(), points[last[b]].tolist())]
    spelled = [text[x:y] for x, y in zip(s.tolist(), e.tolist())]
    keys = [likeness(w) | {"@" + p for p in locals_ if p in w.lower()} for w in spelled]
    # A span of several words is known by all of it, at its last word; its parts alone are no repeats of it.
    for k, own in enumerate(spans):
        for x, y in own:
            i, j = int(np.searchsorted(e, x, side="right")), int(np.searchsorted(s, y, side="left"))
            if j > i:
                for n in range(i, j):
                    keys[n] = set() if j > i + 1 else keys[n]
                keys[j - 1] = keys[j - 1] | likeness(text[x:y])
    return Tokens(s, e, at, spelled, before, keys)


def labels_of(t: Tokens, spans: list[list[tuple[int, int]]]) -> np.ndarray:
    """For each token the kind (from 1) of a pattern's span that it overlaps, or 0; the first kind wins."""
    out = np.zeros(len(t.first), np.int64)
    for k in range(len(KINDS), 0, -1):
        for s, e in spans[k - 1]:
            out[np.searchsorted(t.last, s, side="right") : np.searchsorted(t.first, e, side="left")] = k
    return out


class Field(NamedTuple):
    """The weights: of features by label, and of pairs of labels along chain and skip edges."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def fit(x: np.ndarray, y: np.ndarray, chain: np.ndarray, skip: np.ndarray, use: np.ndarray, steps: int = 600, decay: float = 1e-4) -> Field:
    """Maximum pseudo-likelihood by gradient ascent with momentum: labels given their features and their neighbours' labels.

    use says which labels are learned: 2 for values added to the texts, 1 for the texts' own tokens, of which an even share
    of OWN_SHARE times as many is taken, 0 for what is observed or unknown. All kinds share the skip weights: one for two tokens of one kind, of two kinds, of a kind and none, of none and none.
    """
    size, f = len(KINDS) + 1, x.shape[1]
    beside = []
    for e in (chain, skip):
        n = np.zeros((len(x), size), np.float32)
        if len(e):
            np.add.at(n, e[:, 0], np.eye(size, dtype=np.float32)[y[e[:, 1]]])
            np.add.at(n, e[:, 1], np.eye(size, dtype=np.float32)[y[e[:, 0]]])
        beside.append(n)
    own = np.flatnonzero(use == 1)
    own = own[:: max(1, len(own) // max(1, OWN_SHARE * int((use == 2).sum())))]
    use = np.concatenate([np.flatnonzero(use == 2), own])
    full = np.concatenate([x, *beside], 1)[use]
    target = np.eye(size, dtype=np.float32)[y[use]]
    same = np.eye(size, dtype=bool)
    kind = np.ones(size, bool)
    kind[0] = False
    both = kind[:, None] & kind
    ties = [both & same, both & ~same, ~both & ~same, ~both & same]
    w = np.zeros((full.shape[1], size), np.float32)
    v = np.zeros_like(w)
    for _ in range(steps):
        z = full @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        v = 0.9 * v + full.T @ (target - p) / max(len(full), 1) - decay * w
        w += 0.5 * v
        w[f : f + size] = (w[f : f + size] + w[f : f + size].T) / 2  # a pair's weight is the same from either side
        for tie in ties:
            w[f + size :][tie] = w[f + size :][tie].mean()
    return Field(w[:f], w[f : f + size], w[f + size :])


def altered(kind: str, value: str, rng: random.Random) -> str:
    """The value as a person may write it again, so that no pattern finds it."""
    digits = re.sub(r"[^0-9]", "", value)
    if kind == "email":
        return value.replace("@", rng.choice(["(at)", "[at]", "_at_"]))
    if kind == "ip":
        return value.replace(".", rng.choice("-_/"))
    if kind == "card":
        return rng.choice("/_.").join(digits[k : k + 4] for k in range(0, len(digits), 4))
    digits = digits[rng.randrange(0, max(1, len(digits) - 8)) :]
    return rng.choice(["-", ".", "/", ""]).join([digits[:-7], digits[-7:-4], digits[-4:]]).strip("-./")


def foreign(value: str, rng: random.Random) -> str:
    """Another value of the same shape."""
    return "".join(rng.choice("0123456789") if c.isdigit() else rng.choice("abcdefghijklmnopqrstuvwxyz") if c.isalpha() else c for c in value)


def with_repeats(text: str, rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with altered repeats of values that the patterns find in it, and as many altered values that it doesn't
    hold, added: (start, end, label) of each, label 0 for values it doesn't hold."""
    found = [(k, text[s:e]) for k, own in enumerate(base_spans(text)) for s, e in own]
    added = []
    for k, value in rng.sample(found, min(4, len(found))):
        other = foreign(value, rng)
        for _ in range(rng.randrange(1, 4)):
            added += [(altered(KINDS[k], value, rng), k + 1), (altered(KINDS[k], other, rng), 0)]
    rng.shuffle(added)
    out, at = [text], len(text)
    places = []
    for w, label in added:
        lead = rng.choice([" and then ", " 12 ", " see ", " Tel ", " again, "])
        places.append((at + len(lead), at + len(lead) + len(w), label))
        out += [lead, w]
        at += len(lead) + len(w)
    return "".join(out), places


def lesson(text: str, rng: random.Random) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Features, labels, chain and skip edges, and which tokens are learned from, of a text with repeats added.

    What the patterns find is observed, as it is when the field labels; learned are the added values, and the text's own
    tokens that no pattern found and that repeat nothing found.
    """
    full, places = with_repeats(text, rng)
    batch = pa.RecordBatch.from_arrays([pa.array([full], pa.string())], names=["t"])
    (_, _, spans, t), = _marked_rows(batch, 0)
    if t is None:
        return None
    base = labels_of(t, spans)
    chain, skip = edges(t)
    skip = anchored(t, base, skip)
    y, use = base.copy(), (base == 0).astype(np.int8)
    for e in (skip, skip[:, ::-1]):
        use[e[base[e[:, 1]] > 0, 0]] = 0
    for s, e, label in places:
        own = slice(np.searchsorted(t.last, s, side="right"), np.searchsorted(t.first, e, side="left"))
        free = base[own] == 0
        y[own][free], use[own][free] = label, 2
    keep = min(len(y), SAMPLE_TOKENS)
    first = len(y) - keep  # the added values are at the end
    chain, skip = (e[(e >= first).all(1)] - first for e in (chain, skip))
    return features(t)[first:], y[first:], chain, skip, use[first:]


def marginals(unary: np.ndarray, links: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS) -> np.ndarray:
    """Loopy sum-product: label probabilities of every token. links: edges and their pair weights.

    A round passes messages from the first token to the last and back, each with what it has just received, so one
    round carries a label along a chain of any length. Rounds end when no message changes by SETTLED any more.
    """
    n, size = unary.shape
    edges_ = [(int(x), int(y), np.exp(w)) for e, w in links for x, y in e]
    belief = unary.astype(np.float64)
    if edges_:
        message = np.zeros((2 * len(edges_), size))
        steps = [(x, y, 2 * k, 2 * k + 1, w) for k, (x, y, w) in enumerate(edges_)] + [(y, x, 2 * k + 1, 2 * k, w.T) for k, (x, y, w) in enumerate(edges_)]
        order = sorted((s for s in steps if s[1] > s[0]), key=lambda s: s[:2]) + sorted((s for s in steps if s[1] < s[0]), key=lambda s: s[:2], reverse=True)
        for k in range(rounds):
            most, keep = 0.0, 0.0 if k < UNDAMPED else 0.5
            for source, target, to, back, w in order:
                out = belief[source] - message[back]
                out = np.log(np.exp(out - out.max()) @ w + 1e-30)
                change = (1 - keep) * (out - out.max() - message[to])
                message[to] += change
                belief[target] += change
                most = max(most, np.abs(change).max())
            if most < SETTLED:
                break
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(t: Tokens, base: np.ndarray, p: np.ndarray, text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring tokens that the field is sure of and no pattern has found, without their outer signs."""
    out: list[list[tuple[int, int]]] = [[] for _ in KINDS]
    label = np.where((p.max(1) >= SURE) & (base == 0), p.argmax(1), 0)
    i = 0
    while i < len(label):
        j = i + 1
        if k := int(label[i]):
            while j < len(label) and label[j] == k and t.number[j] == t.number[j - 1] + 1:
                j += 1
            s, e = int(t.first[i]), int(t.last[j - 1])
            while s < e and text[s] in _EDGE:
                s += 1
            while s < e and text[e - 1] in _EDGE:
                e -= 1
            if s < e:
                out[k - 1].append((s, e))
        i = j
    return out


def _marked_rows(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, str, list[list[tuple[int, int]]], Tokens | None]]:
    """Every row: its number, text, pattern spans and marked tokens (None where the text has no digit and no at-sign)."""
    data, starts = common.utf8(batch.column(column))
    for i, j in common.slices(starts, 1 << 20):
        own, begin = data[starts[i] : starts[j]], starts[i : j + 1] - starts[i]
        first, last, row = words.word_spans(own, begin)
        upto = np.zeros(len(own) + 1, np.int64)
        np.cumsum(_MARK[own], out=upto[1:])
        marked = upto[last] > upto[first]
        cut = np.searchsorted(row, np.arange(j - i + 1))
        for r in range(j - i):
            s, e = cut[r], cut[r + 1]
            if not marked[s:e].any():
                yield i + r, "", [[], [], [], []], None
                continue
            raw = own[begin[r] : begin[r + 1]]
            text = raw.tobytes().decode()
            spans = base_spans(text)
            yield i + r, text, spans, tokens_of(text, spans, raw, first[s:e] - begin[r], last[s:e] - begin[r], marked[s:e])


def _sampled(docs: DataFrame) -> Field:
    """The field fitted on SAMPLE different texts at most, those of the least hash, with altered repeats added to each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, text in zip(*(c.to_pylist() for c in b.columns)):
                if got := lesson(text, random.Random(h)):
                    yield pa.RecordBatch.from_arrays([pa.array([h]), *(pa.array([x.tobytes()], pa.binary()) for x in got)], names=["h", "x", "y", "chain", "skip", "use"])

    n = docs.count()
    # Half as many again by their hash, so that what is sorted is bounded; of these the least SAMPLE.
    share = F.pmod("h", F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, 1.5 * SAMPLE / max(n, 1)))
    some = docs.select(F.xxhash64("text").alias("h"), "text").where(share).groupBy("h").agg(F.first("text").alias("text"))
    rows = some.orderBy(F.pmod("h", F.lit(1 << 20)), "h").limit(SAMPLE).mapInArrow(work, "h long, x binary, y binary, chain binary, skip binary, use binary").collect()
    parts: list[list[np.ndarray]] = [[np.zeros((0, len(FEATURES)), np.float32)], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int8)]]
    at = 0
    for r in sorted(rows):
        x, y, chain, skip, use = (np.frombuffer(v, kind).reshape(shape) for v, kind, shape in zip(r[1:], (np.float32, np.int64, np.int64, np.int64, np.int8), ((-1, len(FEATURES)), -1, (-1, 2), (-1, 2), -1)))
        for to, v in zip(parts, (x, y, chain + at, skip + at, use)):
            to.append(v)
        at += len(y)
    return fit(*(np.concatenate(v) for v in parts))


def label(t: Tokens, base: np.ndarray, field: Field) -> np.ndarray:
    """Label probabilities of a text's tokens; those that the patterns labelled are observed."""
    unary = (features(t) @ field.unary).astype(np.float64)
    seen = base > 0
    unary[seen] = -1e12  # no number of repeats outweighs what is observed
    unary[seen, base[seen]] = 0.0
    chain, skip = edges(t)
    return marginals(unary, [(chain, field.chain), (anchored(t, base, skip), field.skip)])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """For each row: id, n_email, n_ip, n_card, n_phone, base_spans and spans.

    The counts and base_spans are those of the patterns, in code points, end exclusive. spans has besides what the
    field labels: words with a digit, an at-sign or an email's local part are its tokens, neighbours and tokens that
    repeat or resemble one another share potentials, each repeat also with the nearest one that a pattern labelled, and
    loopy message passing, until it settles, carries the labels of what the patterns found to the rest of the document.
    The field is fitted on SAMPLE texts at most, to which altered repeats of what the patterns find are added, unless one
    is given. A null or empty text has no spans, a very long one is one field, held by itself; rows of one id give a row
    each, equal texts equal spans; an empty table gives no rows. Columns other than the id and the text are not carried,
    whatever they are called. Nothing is shuffled but the sample.
    """
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    if field is None:
        field = _sampled(rows)
    given = field
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base_spans", T.StringType()), T.StructField("spans", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = np.zeros((len(KINDS), b.num_rows), np.int64)
            base, full = [""] * b.num_rows, [""] * b.num_rows
            for i, text, spans, t in _marked_rows(b, 1):
                if t is None:
                    continue
                counts[:, i] = [len(s) for s in spans]
                base[i] = full[i] = written(spans)
                own = labels_of(t, spans)
                extra = added_spans(t, own, label(t, own, given), text)
                if any(extra):
                    full[i] = written([s + x for s, x in zip(spans, extra)])
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, counts), pa.array(base, pa.string()), pa.array(full, pa.string())], names=[f.name for f in out.fields])

    return rows.mapInArrow(work, out)
