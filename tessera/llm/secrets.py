"""Secrets in texts: fixed patterns, and a linear-chain conditional random field that adds to them."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.frames import free_name, written

#: Kinds of spans in the order in which those with one start are listed; the last is the field's own.
KINDS = ("assign", "access", "hex", "field")
#: The patterns of the base and the least characters of a match, or of its second group.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
#: Parts of the assignment words, one of which a text must hold in lower case to be searched.
HINTS = ("passw", "secret", "token", "api")
#: Bytes that are hexadecimal digits as one letter, all others as a space.
HEX_MAP = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))

#: Tokens: runs of letters, digits and a few signs, or one other sign.
TOKEN = re.compile(r"[\w+/-]+|[^\w+/\-\x20\x09-\x0D]")
#: States: outside, begin, inside.
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
#: Buckets of the hashed features.
BUCKETS = 1 << 18
#: Rows looked at for windows to learn from, windows of either sort, tokens of a window.
CANDIDATES, WINDOWS, WIDTH = 1 << 15, 1000, 48
#: Tokens a worker remembers, and tokens that are tagged together.
REMEMBERED, TOGETHER = 1 << 18, 1 << 19


def base_spans(text: str, data: bytes) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) of the fixed patterns, by start and kind."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_LEAST:
                found.append((m.start(), 0, m.end(), m.start(2)))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    if b"x" * HEX_LEAST in data.translate(HEX_MAP):
        found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text) if len(m[0]) >= HEX_LEAST]
    return sorted(found)


#: Bytes as kinds of characters: small and capital letters, digits, other alphabets; signs as themselves.
KIND_MAP = bytes(
    97 if 97 <= b <= 122 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 119 if b >= 128 else b for b in range(256)
)
#: What a token says: to itself, and to its neighbours. Their distance, and what stands beyond a text.
ROLES = {"own": 0, "before": 1, "twice before": 2, "after": -1}
EDGE = "\n"
#: Odd numbers that spread a word's checksum to a bucket of its own in each role.
SPREAD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint64)


def _hashed(names: list[str]) -> list[int]:
    return [zlib.crc32(n.encode()) % BUCKETS for n in names]


def shape(token: str) -> tuple:
    """What a token looks like: kinds of characters, length, how often kinds change, variety, vowels.

    Words of letters alone are told apart by length only.
    """
    data = token[:64].encode()
    kinds = data.translate(KIND_MAP)
    length = min(len(token), 12 + min(len(token) // 8, 8))
    if not kinds.strip(b"aw") and len(token) < 16:
        return ("a", length)
    present = bytes(sorted(set(kinds)))[:8].decode()
    if len(token) == 1:
        return (present, 1)
    changes = sum(map(int.__ne__, kinds, kinds[1:]))
    size = len(data)
    hexadecimal = not data.strip(b"0123456789abcdef")
    vowels = size - len(data.translate(None, b"aeiouAEIOU"))
    return (present, length, min(changes, 12), min(len(set(data)), 16) // 2, size // 4, hexadecimal, 4 * vowels // size)


def shape_features(look: tuple, role: str) -> list[int]:
    """Buckets of a shape: six for the token itself, three for a neighbour."""
    present, length, changes, variety, size, hexadecimal, vowels = (*look, *(0,) * 7)[:7]
    names = [f"{role} kinds {present}", f"{role} length {length}", f"{role} both {present} {size}"]
    if role == "own":
        names += [f"changes {changes} {size // 2}", f"variety {variety} {size // 2}", f"hexadecimal {hexadecimal} {size // 2} {vowels}", "always"]
    return _hashed(names)


def word_buckets(tokens: list[str]) -> np.ndarray:
    """By token and role, the bucket of a sign or a short word itself, in lower case; one for all others.

    A secret is met once, so its own letters say nothing about the next.
    """
    words = [t.lower() if len(t) == 1 or len(t) <= 16 and t.isalpha() else "" for t in tokens]
    sums = np.array([zlib.crc32(w.encode()) for w in words], dtype=np.uint64)
    return ((sums[:, None] * SPREAD >> np.uint64(12)) % np.uint64(BUCKETS)).astype(np.int64)


def file_features(signs: float, digits: float, count: float) -> list[int]:
    """Buckets of a whole text: parts of its tokens that are signs or hold digits, and its length."""
    return _hashed(
        [
            f"file signs {int(signs / count * 10) if count else 0}",
            f"file digits {int(min(digits / count * 20, 10)) if count else 0}",
            f"file length {int(count).bit_length()}",
        ]
    )


def flags(look: tuple) -> tuple[bool, bool]:
    """Whether a token of this shape is a sign, and whether it has digits."""
    return not set(look[0]) & set("aAw0"), "0" in look[0]


@dataclass
class Field:
    """Weights of a linear-chain field: features by state, first state, and state by state."""

    weights: np.ndarray
    start: np.ndarray
    steps: np.ndarray

    def lead(self) -> float:
        """By how much the steps can speak against being outside at one place, at most."""
        into = np.concatenate((self.steps, self.start[None]))
        out = np.concatenate((self.steps, np.zeros((3, 1))), axis=1)
        against = into[:, None, 1:] - into[:, None, :1]
        beyond = out[None, 1:, :].transpose(0, 2, 1) - out[None, :1, :].transpose(0, 2, 1)
        return float((against.max(axis=(0, 1)) + beyond.max(axis=(0, 1))).max())


def untrained() -> Field:
    """A field that finds nothing."""
    weights = np.zeros((BUCKETS, 3))
    weights[shape_features(("a", 1), "own")[-1], OUTSIDE] = 1.0
    return Field(weights, np.zeros(3), np.zeros((3, 3)))


def marginals(field: Field, scores: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log partition, state and step probabilities of padded sequences; the forward-backward sums."""
    count, width = scores.shape[:2]
    inside = np.arange(width)[None, :] < sizes[:, None]
    forward, backward = np.empty_like(scores), np.zeros_like(scores)
    forward[:, 0] = field.start + scores[:, 0]
    for t in range(1, width):
        new = np.logaddexp.reduce(forward[:, t - 1, :, None] + field.steps, axis=1) + scores[:, t]
        forward[:, t] = np.where(inside[:, t, None], new, forward[:, t - 1])
    for t in range(width - 2, -1, -1):
        new = np.logaddexp.reduce(field.steps + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
        backward[:, t] = np.where(inside[:, t + 1, None], new, backward[:, t + 1])
    whole = np.logaddexp.reduce(forward[:, -1], axis=1)
    states = np.exp(forward + backward - whole[:, None, None]) * inside[:, :, None]
    steps = np.zeros((3, 3))
    for t in range(1, width):
        both = forward[:, t - 1, :, None] + field.steps + (scores[:, t] + backward[:, t])[:, None, :]
        steps += (np.exp(both - whole[:, None, None]) * inside[:, t, None, None]).sum(axis=0)
    return whole, states, steps


def gradient(field: Field, features: np.ndarray, tags: np.ndarray, sizes: np.ndarray, penalty: float) -> tuple[float, Field]:
    """Negative log-likelihood with a square penalty, and its derivatives.

    ``features`` are (sequence, token, feature) rows of ``field.weights``, ``tags`` the states;
    sequences are padded to one width.
    """
    inside = np.arange(tags.shape[1])[None, :] < sizes[:, None]
    scores = field.weights[features].sum(axis=2) * inside[:, :, None]
    whole, states, steps = marginals(field, scores, sizes)
    right = np.eye(3)[tags] * inside[:, :, None]
    pairs = np.zeros((3, 3))
    both = inside[:, 1:]
    np.add.at(pairs, (tags[:, :-1][both], tags[:, 1:][both]), 1)
    found = (scores * right).sum() + field.start[tags[:, 0]].sum() + (pairs * field.steps).sum()
    squares = sum((w**2).sum() for w in (field.weights, field.start, field.steps))
    loss = whole.sum() - found + penalty / 2 * squares
    off = (states - right).reshape(-1, 3)
    by = np.stack(
        [np.bincount(features.ravel(), np.repeat(off[:, s], features.shape[2]), len(field.weights)) for s in range(3)], axis=1
    )
    return float(loss), Field(
        by + penalty * field.weights, (states[:, 0] - right[:, 0]).sum(axis=0) + penalty * field.start, steps - pairs + penalty * field.steps
    )


def fitted(features: np.ndarray, tags: np.ndarray, sizes: np.ndarray, rounds: int = 60, penalty: float = 0.05) -> Field:
    """The field that `gradient` leads to by Adam steps over all sequences."""
    used, index = np.unique(features, return_inverse=True)
    index = index.reshape(features.shape)
    field = Field(np.zeros((len(used), 3)), np.zeros(3), np.zeros((3, 3)))
    parts = ("weights", "start", "steps")
    mean = {p: np.zeros_like(getattr(field, p)) for p in parts}
    square = {p: np.zeros_like(getattr(field, p)) for p in parts}
    for k in range(1, rounds + 1):
        _, slope = gradient(field, index, tags, sizes, penalty)
        for p in parts:
            g = getattr(slope, p)
            mean[p] = 0.9 * mean[p] + 0.1 * g
            square[p] = 0.99 * square[p] + 0.01 * g * g
            step = mean[p] / (1 - 0.9**k) / (np.sqrt(square[p] / (1 - 0.99**k)) + 1e-8)
            getattr(field, p)[...] -= 0.5 / (1 + k / 30) * step
    weights = np.zeros((BUCKETS, 3))
    weights[used] = field.weights
    return Field(weights, field.start, field.steps)


def windows(text: str, plain: bool, count: int = 4) -> list[tuple[bool, np.ndarray, bytes]]:
    """(whether it holds a secret, buckets by token, states) of some windows of a text.

    They lie around up to ``count`` base spans at equal distances in their list, and if ``plain``
    around a token that the text's checksum points to.
    """
    data = text.encode()
    spans = base_spans(text, data)
    if not spans and not plain:
        return []
    matches = list(TOKEN.finditer(text))
    if not matches:
        return []
    tokens = [m[0] for m in matches]
    starts = np.array([m.start() for m in matches])
    states = np.zeros(len(tokens), dtype=np.uint8)
    centres = []
    for _, _, end, secret in spans:
        # Tokens that overlap the secret itself.
        first = max(0, int(np.searchsorted(starts, secret, "right")) - 1)
        last = max(first, int(np.searchsorted(starts, end, "left")) - 1)
        if not states[first : last + 1].any():
            states[first : last + 1] = INSIDE
            states[first] = BEGIN
        centres.append(first)
    chosen = [centres[k * len(centres) // min(count, len(centres))] for k in range(min(count, len(centres)))]
    chosen += [zlib.crc32(data) % len(tokens)] * plain
    looks = [shape(t) for t in tokens]
    told = np.array([flags(x) for x in looks]).sum(axis=0)
    file = file_features(*told, len(tokens))
    found = []
    for centre in dict.fromkeys(chosen):
        low = max(0, centre - WIDTH // 2)
        high = min(len(tokens), low + WIDTH)
        columns = [np.array([file] * (high - low))]
        for k, (role, back) in enumerate(ROLES.items()):
            near = [i - back for i in range(low, high)]
            seen = [0 <= i < len(tokens) for i in near]
            columns.append(np.array([shape_features(looks[i] if ok else shape(EDGE), role) for i, ok in zip(near, seen, strict=True)]))
            columns.append(word_buckets([tokens[i] if ok else EDGE for i, ok in zip(near, seen, strict=True)])[:, k : k + 1])
        tags = states[low:high].copy()
        # A window may begin inside a secret.
        tags[0] = BEGIN if tags[0] == INSIDE else tags[0]
        found.append((bool(tags.any()), np.concatenate(columns, axis=1).astype(np.int32), tags.tobytes()))
    return found


def learned(docs: DataFrame, columns: list[str], text: str) -> Field:
    """A field that has learned the base spans of some windows.

    About ``CANDIDATES`` rows with the smallest hashes of ``columns`` and text are looked at for base
    spans, equal rows once, and twice ``WINDOWS`` of these also for a window anywhere; of the windows
    with and without a secret the ``WINDOWS`` with the smallest hashes reach the driver, as 20 bucket
    numbers a token. That bounds what is learned from, not what is tagged. Without a secret nothing is
    learned, and such a field finds none.
    """
    key = F.pmod(F.xxhash64(*[F.col(c) for c in columns], F.col(text)), F.lit(1 << 30))
    rows = docs.where(F.length(text) > 0).select(key.alias("key"), F.col(text).alias("text"))
    count = max(1, rows.count())
    most, plain = (int(min(1.0, n / count) * (1 << 30)) + 1 for n in (CANDIDATES, 2 * WINDOWS))
    some = rows.where(F.col("key") < most).dropDuplicates(["key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if found := windows(value, key < plain):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([key] * len(found), pa.int64()),
                            pa.array(range(len(found)), pa.int32()),
                            pa.array([f[0] for f in found], pa.bool_()),
                            pa.array([f[1].tobytes() for f in found], pa.binary()),
                            pa.array([f[2] for f in found], pa.binary()),
                        ],
                        names=["key", "n", "secret", "features", "tags"],
                    )

    table = written(some.mapInArrow(cut, "key long, n int, secret boolean, features binary, tags binary"))
    order = [F.xxhash64("key", "n"), "key", "n"]
    taken = [r for s in (True, False) for r in table.where(F.col("secret") == s).orderBy(*order).limit(WINDOWS).collect()]
    if not any(r["secret"] for r in taken):
        return untrained()
    sizes = np.array([len(r["tags"]) for r in taken])
    each = len(np.frombuffer(taken[0]["features"], dtype=np.int32)) // sizes[0]
    features = np.zeros((len(taken), WIDTH, each), dtype=np.int64)
    tags = np.zeros((len(taken), WIDTH), dtype=np.int64)
    for k, r in enumerate(taken):
        features[k, : sizes[k]] = np.frombuffer(r["features"], dtype=np.int32).reshape(-1, each)
        tags[k, : sizes[k]] = np.frombuffer(r["tags"], dtype=np.uint8)
    return fitted(features, tags, sizes)


def best_states(field: Field, scores: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """The most likely states of texts laid end to end, by Viterbi.

    Where being outside leads by more than the steps to both neighbours can take back, the best
    sequence is outside; the stretches between such places are decoded by themselves, those of one
    length and more step by step together.
    """
    count = len(scores)
    states = np.zeros(count, dtype=np.int8)
    open_ = scores[:, OUTSIDE] - np.maximum(scores[:, BEGIN], scores[:, INSIDE]) <= field.lead() + 1e-6
    if not open_.any():
        return states
    begins_text = np.r_[True, text_of[1:] != text_of[:-1]]
    ends_text = np.r_[begins_text[1:], True]
    first = np.flatnonzero(open_ & (begins_text | ~np.r_[False, open_[:-1]]))
    last = np.flatnonzero(open_ & (ends_text | ~np.r_[open_[1:], False]))
    size = last - first + 1
    order = np.argsort(-size, kind="stable")
    first, last, size = first[order], last[order], size[order]
    outer = np.where(begins_text[first][:, None], field.start, field.steps[OUTSIDE])
    score = outer + scores[first]
    came = np.zeros((int(size.sum()), 3), dtype=np.int8)
    at = np.cumsum(size) - size
    longer = len(size)
    for t in range(1, int(size[0])):
        longer = int(np.searchsorted(-size, -t, "left"))
        both = score[:longer, :, None] + field.steps
        came[at[:longer] + t] = both.argmax(axis=1)
        score[:longer] = both.max(axis=1) + scores[first[:longer] + t]
    score = score + np.where(ends_text[last][:, None], 0.0, field.steps[:, OUTSIDE])
    state = score.argmax(axis=1).astype(np.int8)
    for t in range(int(size[0]) - 1, -1, -1):
        longer = int(np.searchsorted(-size, -t, "left"))
        states[first[:longer] + t] = state[:longer]
        state[:longer] = came[at[:longer] + t, state[:longer]]
    return states


class Tagger:
    """States of the tokens of texts; what a token adds to the scores is worked out once and remembered."""

    def __init__(self, field: Field) -> None:
        self.field = field
        self.forget()

    def forget(self) -> None:
        self.words: dict[bytes, int] = {}
        self.tokens: dict[str, int] = {}
        self.looks: dict[tuple, int] = {}
        #: By word, its tokens.
        self.word_at, self.word_tokens = np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.int64)
        #: By shape, what it adds in each role; by token, the same, and whether it is a sign or has digits.
        self.look_scores, self.look_flags = np.empty((0, len(ROLES), 3)), np.empty((0, 2))
        self.scores, self.flags = np.empty((0, len(ROLES), 3)), np.empty((0, 2))
        self.learn_tokens([EDGE])

    def learn_tokens(self, tokens: list[str]) -> None:
        w, looks = self.field.weights, [shape(t) for t in tokens]
        if new := [x for x in dict.fromkeys(looks) if x not in self.looks]:
            self.looks.update(zip(new, range(len(self.looks), len(self.looks) + len(new)), strict=True))
            rows = np.array([[w[shape_features(x, r)].sum(axis=0) for r in ROLES] for x in new])
            self.look_scores = np.concatenate((self.look_scores, rows))
            self.look_flags = np.concatenate((self.look_flags, np.array([flags(x) for x in new], dtype=float)))
        index = [self.looks[x] for x in looks]
        self.tokens.update(zip(tokens, range(len(self.tokens), len(self.tokens) + len(tokens)), strict=True))
        self.scores = np.concatenate((self.scores, self.look_scores[index] + w[word_buckets(tokens)]))
        self.flags = np.concatenate((self.flags, self.look_flags[index]))

    def learn(self, words: list[bytes]) -> None:
        parts = [TOKEN.findall(w.decode()) for w in words]
        new = [t for t in dict.fromkeys(t for p in parts for t in p) if t not in self.tokens]
        if new:
            self.learn_tokens(new)
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words)), strict=True))
        self.word_tokens = np.r_[self.word_tokens, np.array([self.tokens[t] for p in parts for t in p], dtype=np.int64)]
        self.word_at = np.r_[self.word_at, self.word_at[-1] + np.cumsum([len(p) for p in parts])]

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.tokens) > REMEMBERED or len(self.words) > REMEMBERED:
            self.forget()
        split = [t.split() for t in texts]
        known = self.words
        new = [w for w in dict.fromkeys(w for words in split for w in words) if w not in known]
        if new:
            self.learn(new)
        index = np.array([known[w] for words in split for w in words], dtype=np.int64)
        many = np.diff(self.word_at)[index]
        offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        token = self.word_tokens[np.repeat(self.word_at[index], many) + offset]
        word_text = np.repeat(np.arange(len(texts)), [len(words) for words in split])
        text_of = np.repeat(word_text, many)
        counts = np.bincount(text_of, minlength=len(texts))
        signs, digits = (np.bincount(text_of, self.flags[token, c], len(texts)) for c in range(2))
        file = np.array([self.field.weights[file_features(*x)].sum(axis=0) for x in zip(signs, digits, counts, strict=True)])
        scores = self.scores[token, 0] + file.reshape(-1, 3)[text_of]
        for n, back in list(enumerate(ROLES.values()))[1:]:
            other, same = np.roll(token, back), np.roll(text_of, back) == text_of
            if back > 0:
                same[:back] = False
            else:
                same[back:] = False
            scores += self.scores[np.where(same, other, 0), n]
        return np.split(best_states(self.field, scores, text_of), np.cumsum(counts)[:-1])


def field_spans(text: str, states: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches of tokens that begin a secret or go on inside one."""
    found: list[list[int]] = []
    before = -2
    inside = set(np.flatnonzero(states).tolist())
    for i, m in enumerate(TOKEN.finditer(text)):
        if i in inside:
            if states[i] == INSIDE and before == i - 1:
                found[-1][1] = m.end()
            else:
                found.append([m.start(), m.end()])
            before = i
    return [(s, e) for s, e in found]


def secret_spans(docs: DataFrame, columns: list[str], text: str, field: Field) -> DataFrame:
    """(columns, spans): the secrets of each whole text, as (kind, start, end) by start and kind.

    Base spans are the matches of three patterns, leftmost and not overlapping within a kind. The field
    tags every token as outside, begin or inside a secret by its shape, its neighbours and features of
    the text; its stretches are added, as kind ``field``, where they overlap no base span. Positions
    count code points, the end is exclusive. A ``spans`` column in ``columns`` adds an underscore.

    The field's weights go to each task; no row meets another, and texts are tagged several together
    or one long one alone. Null, empty and blank texts have no spans; repeated rows are rows of their
    own; no rows give none.
    """
    name = free_name(docs.select(*columns), "spans")
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in columns)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    sent = docs.sparkSession.sparkContext.broadcast((field.weights, field.start, field.steps))

    def spans_of(value: str, data: bytes, states: np.ndarray) -> list[dict]:
        base = base_spans(value, data)
        if states.any():
            own = [(s, 3, e, s) for s, e in field_spans(value, states)]
            base = sorted(base + [o for o in own if all(o[2] <= b[0] or b[2] <= o[0] for b in base)])
        return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e, _ in base]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(Field(*sent.value))
        for batch in batches:
            at = size = 0
            values: list[str] = []
            for row, value in enumerate(batch.column(0)):
                values.append(value.as_py() or "")
                size += len(values[-1])
                if size < 4 * TOGETHER and row + 1 < batch.num_rows:
                    continue
                data = [v.encode() for v in values]
                found = [spans_of(*x) for x in zip(values, data, tagger(data), strict=True)]
                own = batch.slice(at, len(values)).columns[1:]
                yield pa.RecordBatch.from_arrays([*own, pa.array(found, span)], names=[*batch.schema.names[1:], name])
                at, size, values = row + 1, 0, []

    return docs.select(F.col(text), *columns).mapInArrow(find, f"{kinds}`{name}` array<struct<kind: string, start: long, end: long>>")
