"""Secrets in texts: fixed patterns, and a linear-chain conditional random field over tokens.

A text is a sequence of tokens: runs of letters and digits, and single other characters, each with the white space right before it.
The chain tags each as begin, inside or outside of a secret. Its features are the token's shape, length and wording, those of its
neighbours (key words such as "password" up to four tokens before it), and of the file (how much of it is marks, key words and line
ends). The model is trained by maximum likelihood on texts made by a rule, whose secrets are known (``labelled_texts``); others can be
given to ``fit``. Texts are decoded by Viterbi, all those of a chunk at once: blocks of tokens are reduced side by side to the best
score from each label before to each label at their end, blocks are joined in order, and labels are read backwards in all blocks at
once. Weights are whole numbers, so sums are exact and a text's labels don't depend on what it is decoded with.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HELD, release, table

#: The base patterns and the least lengths of what they match, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # as [0-9a-f]+ of 32 characters or more: the first match in a run takes all of it
KINDS = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))
#: The kind of spans that only the chain finds.
TAGGED = "tagged"

OUTSIDE, BEGIN, INSIDE = range(3)
TOKEN = re.compile(r"[\x20\x09-\x0D]?(?:[^\W_]+|[^\x20\x09-\x0D])")
HEX_DIGITS = frozenset("0123456789abcdef")
CONSONANTS = re.compile(r"[bcdfghjklmnpqrstvwxz]{4,}")
SPACE = " \t\n\v\f\r"
KEYS = {
    "pass": "password passwd passwort pwd pass passphrase contraseña kennwort motdepasse",
    "secret": "secret secrets private credential credentials",
    "token": "token tokens bearer auth authorization jwt session",
    "key": "key keys apikey accesskey secretkey privatekey clientsecret",
    "part": "api access client aws account db database",
    "begun": "akia asia ghp gho ghs glpat sk pk xoxb xoxp eyj aiza ya29 live test npm hf",
}
KEY_OF = {w: k for k, words in KEYS.items() for w in words.split()}
#: Neighbours that are looked at: offsets, and whether only marks and key words of them count.
NEIGHBOURS = {-4: True, -3: True, -2: True, -1: False, 1: False, 2: True}
EDGE_TOKENS = 4
SCALE = 1 << 20
#: Tokens of at most LONG_TOKEN characters that a task remembers.
MOST_TOKENS, LONG_TOKEN = 200_000, 40
CHUNK_CHARS = 2 << 20
BLOCK_TOKENS = 128
NEVER = -(1 << 40)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the patterns, leftmost and non-overlapping for each kind; too short matches are dropped."""
    out = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        out += [(m.start(), m.end(), rank, kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(a, b, kind) for a, b, _, kind in sorted(out)]


def _bucket(n: int, *bounds: int) -> int:
    return bisect(bounds, n)


def profile(token: str) -> tuple:
    """What counts of one token (with the white space before it); tokens of the same profile are one type: white space, shape, size,
    switches between letters and digits, turns from small to capital letters, longest run of consonants, key word, whether
    that is the whole word. Of a mark, the shape is the mark."""
    word = token.lstrip(SPACE)
    gap = "none" if len(word) == len(token) else "line" if token[0] in "\n\v\f\r" else "space"
    if not word[0].isalnum():
        return gap, word if word in string.punctuation else "other", 0, 0, 0, 0, "", False
    lower, n = word.lower(), len(word)
    digits = caps = switches = turns = 0
    if not word.isalpha():
        digits = sum(map(str.isdigit, word))
        switches = sum(a.isdigit() != b.isdigit() for a, b in zip(word, word[1:])) if digits < n else 0
    if lower != word:
        caps = sum(map(str.isupper, word))
        turns = sum(a.islower() and b.isupper() for a, b in zip(word, word[1:])) if caps < n else 0
    if not word.isascii():
        shape = "foreign"
    elif digits == n:
        shape = "digits"
    elif digits:
        shape = "hex" if set(word) <= HEX_DIGITS else "lower9" if not caps else "upper9" if caps + digits == n else "mixed9"
    else:
        shape = "lower" if not caps else "upper" if caps == n else "title" if caps == 1 and word[0].isupper() else "mixed"
    key = KEY_OF.get(lower, "")
    whole = bool(key)
    if not key and shape[-1] == "9":
        key = next((KEY_OF[lower[:k]] for k in (5, 4, 3) if KEY_OF.get(lower[:k]) == "begun"), "")
    run = max(map(len, CONSONANTS.findall(lower)), default=0)
    return gap, shape, _bucket(n, 2, 4, 8, 12, 16, 20, 28, 36, 48), _bucket(switches, 1, 2, 3, 5, 8), _bucket(turns, 1, 2, 3), _bucket(run, 4, 5, 6, 7, 8), key, whole


def profile_features(own: tuple) -> tuple[list[str], list[str]]:
    """Names of the features of a profile: those that count for distant neighbours too, and all."""
    gap, shape, size, switches, turns, run, key, _ = own
    if not shape[0].isalpha() or shape == "other":
        return [f"mark:{shape}"], [f"mark:{shape}", f"gap:{gap}"]
    first = [f"key:{key}"] if key else []
    every = [f"gap:{gap}", f"shape:{shape}", f"size:{size}", f"shape:{shape},size:{size}", f"gap:{gap},shape:{shape}", f"switches:{switches}", f"turns:{turns}", f"run:{run}", f"shape:{shape},run:{run}"]
    return first, [*first, *every]


def _facts(own: tuple) -> tuple[int, int, int]:
    """What of a file is counted: marks, key words, line ends."""
    return int(not own[1][0].isalpha() or own[1] == "other"), int(own[7]), int(own[0] == "line")


def file_features(n: int, marks: int, keys: int, lines: int) -> list[str]:
    n = max(n, 1)
    return [f"file:marks:{_bucket(100 * marks // n, 8, 20, 35)}", f"file:keys:{_bucket(100 * keys // n, 1, 4, 10)}", f"file:lines:{_bucket(100 * lines // n, 2, 6, 12)}"]


class Tagger:
    """Weights of the chain: feature to three scores; ``moves[a][b]`` is the score of label b after label a."""

    def __init__(self, weights: dict[str, np.ndarray], moves: np.ndarray):
        self.weights = {k: np.rint(np.asarray(w) * SCALE).astype(np.int64) for k, w in weights.items()}
        self.moves = np.rint(np.asarray(moves) * SCALE).astype(np.int64)
        self.moves[OUTSIDE, INSIDE] = NEVER

    def types(self) -> _Types:
        return _Types(self.weights)

    def tags(self, texts: list[str], types: _Types | None = None) -> list[np.ndarray]:
        """The best labels of each text's tokens."""
        types = types if types is not None else self.types()
        found = [list(map(types.__getitem__, TOKEN.findall(t))) for t in texts]
        sizes = np.array([len(f) for f in found])
        edge = [0] * EDGE_TOKENS
        line: list[int] = list(edge)
        for f in found:
            line += f
            line += edge
        ids = np.array(line)
        starts = EDGE_TOKENS + np.concatenate([[0], np.cumsum(sizes + EDGE_TOKENS)[:-1]]).astype(int)
        emit = types.emissions(ids)
        facts = types.facts()
        for start, size in zip(starts, sizes):
            if size:
                counts = facts[ids[start : start + size]].sum(0)
                emit[start : start + size] += sum((self.weights[f] for f in file_features(size, *counts.tolist()) if f in self.weights), np.zeros(3, np.int64))
        emit[ids == 0] = (0, NEVER, NEVER)
        labels = best_labels(emit, self.moves)
        return [labels[a : a + n] for a, n in zip(starts, sizes)]

    def spans(self, text: str, labels: np.ndarray) -> list[tuple[int, int]]:
        """Spans of the secrets that labels of a text's tokens say."""
        if not labels.any():
            return []
        out: list[tuple[int, int]] = []
        for m, label in zip(TOKEN.finditer(text), labels.tolist()):
            if label == BEGIN:
                out.append((m.end() - len(m[0].lstrip(SPACE)), m.end()))
            elif label == INSIDE:
                out[-1] = (out[-1][0], m.end())
        return out


class _Types(dict):
    """Numbers of tokens' types: tokens with the same features are one type; 0 is the edge of a text. A type's scores, as itself and as
    a neighbour, are in a table. Tokens are remembered (at most MOST_TOKENS, twice that between clearings; long ones never)."""

    def __init__(self, weights: dict[str, np.ndarray]):
        super().__init__()
        self.weights = weights
        self.old: dict[str, int] = {}
        self.numbers: dict[tuple, int] = {}
        self.rows = [[_total(weights, [f"{o}:edge"]) for o in (0, *NEIGHBOURS)]]
        self.counts = [(0, 0, 0)]
        self._done = np.zeros((1 + len(NEIGHBOURS), 0, 3), np.int64)

    def __missing__(self, token: str) -> int:
        if (n := self.old.get(token)) is None:
            n = self._number(token)
        if len(token) <= LONG_TOKEN:
            self[token] = n
        return n

    def _number(self, token: str) -> int:
        key = profile(token)
        if (n := self.numbers.get(key)) is None:
            first, every = profile_features(key)
            self.rows.append([_total(self.weights, [f"{o}:{f}" for f in (first if NEIGHBOURS.get(o) else every)]) for o in (0, *NEIGHBOURS)])
            self.counts.append(_facts(key))
            n = self.numbers[key] = len(self.rows) - 1
        return n

    def rest(self) -> None:
        """Between chunks: forgets tokens not met of late."""
        if len(self) > MOST_TOKENS:
            self.old = dict(self)
            self.clear()

    def facts(self) -> np.ndarray:
        return np.array(self.counts)

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        if self._done.shape[1] < len(self.rows):
            self._done = np.ascontiguousarray(np.array(self.rows).transpose(1, 0, 2))
        out = self._done[0][ids]
        for scores, offset in zip(self._done[1:], NEIGHBOURS):
            if offset < 0:
                out[-offset:] += scores[ids[:offset]]
            else:
                out[:-offset] += scores[ids[offset:]]
        return out


def _total(weights: dict[str, np.ndarray], names: list[str]) -> np.ndarray:
    return sum((weights[n] for n in names if n in weights), np.zeros(3, np.int64))


def best_labels(emit: np.ndarray, moves: np.ndarray, block: int = BLOCK_TOKENS) -> np.ndarray:
    """Viterbi over a sequence that begins after label OUTSIDE: the labels with the greatest sum of whole-number scores."""
    n = len(emit)
    if not n:
        return np.zeros(0, np.int8)
    count = -(-n // block)
    padded = np.zeros((count * block, 3), np.int64)
    padded[:n] = emit
    steps = np.ascontiguousarray(padded.reshape(count, block, 3).transpose(1, 2, 0))
    back = np.zeros((block, 3, 3, count), np.int8)  # the label before, by label now and label before the block
    score = [moves[:, c, None] + steps[0, c] for c in range(3)]  # by label now: label before the block, block
    for t in range(1, block):
        after = []
        for c in range(3):
            from_o, from_b, from_i = (score[k] + moves[k, c] for k in range(3))
            best = np.maximum(from_o, from_b)
            np.greater(from_b, from_o, out=back[t, c], casting="unsafe")
            back[t, c][from_i > best] = INSIDE
            after.append(np.maximum(best, from_i) + steps[t, c])
        score = after
    into = np.zeros((count, 3), np.int8)
    now = [0, NEVER * 4, NEVER * 4]
    for k, ways_in in enumerate(np.stack(score, 2).transpose(1, 2, 0).tolist()):  # by block: label now, label before
        ways = [[n_ + w for n_, w in zip(now, ways_in[c])] for c in range(3)]
        now = [max(w) for w in ways]
        into[k] = [w.index(m) for w, m in zip(ways, now)]
    end, ends, begins = now.index(max(now)), np.zeros(count, np.int8), np.zeros(count, np.int8)
    for k in range(count - 1, -1, -1):
        ends[k] = end
        end = begins[k] = into[k, end]
    labels = np.zeros((count, block), np.int8)
    each, here = np.arange(count), ends
    for t in range(block - 1, -1, -1):
        labels[:, t] = here
        if t:
            here = back[t, here, begins, each]
    return labels.reshape(-1)[:n]


# Training


def _active(text: str) -> list[list[str]]:
    """The features of each token of a text, edges included."""
    tokens = TOKEN.findall(text)
    own = [profile(t) for t in tokens]
    first, every = zip(*map(profile_features, own)) if own else ((), ())
    counts = np.array([_facts(p) for p in own]).reshape(-1, 3).sum(0).tolist()
    file = file_features(len(tokens), *counts)
    out = []
    for k in range(len(tokens)):
        row = [f"0:{f}" for f in every[k]] + file
        for offset, distant in NEIGHBOURS.items():
            at = k + offset
            row += [f"{offset}:{f}" for f in (first if distant else every)[at]] if 0 <= at < len(tokens) else [f"{offset}:edge"]
        out.append(row)
    return out


def token_labels(text: str, secrets: list[tuple[int, int]]) -> list[int]:
    """Labels of a text's tokens for its secrets (start, end)."""
    out = []
    for m in TOKEN.finditer(text):
        start = m.end() - len(m[0].lstrip(SPACE))
        inside = next(((a, b) for a, b in secrets if a <= start < b), None)
        out.append(OUTSIDE if inside is None else BEGIN if start == inside[0] else INSIDE)
    return out


def fit(texts: list[tuple[str, list[tuple[int, int]]]], steps: int = 120, ridge: float = 1e-3) -> Tagger:
    """A chain fitted to texts with the spans of their secrets, by gradient steps (Adam) on the likelihood. Features that occur
    once are left out."""
    rows = [(active, token_labels(text, spans)) for text, spans in texts if (active := _active(text))]
    seen: dict[str, int] = {}
    for active, _ in rows:
        for f in {f for token in active for f in token}:
            seen[f] = seen.get(f, 0) + 1
    names = sorted(f for f, c in seen.items() if c > 1)
    index = {f: k for k, f in enumerate(names)}
    size, n, longest = len(names), len(rows), max(len(y) for _, y in rows)
    width = max(len(token) for active, _ in rows for token in active)
    x = np.full((n, longest, width), size, np.int32)
    y, mask = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (active, labels) in enumerate(rows):
        for t, token in enumerate(active):
            own = [index[f] for f in token if f in index]
            x[i, t, : len(own)] = own
        y[i, : len(labels)] = labels
        mask[i, : len(labels)] = True
    flat = x[mask]
    one = np.eye(3)
    count = lambda p: np.stack([np.bincount(flat.ravel(), np.repeat(p[:, c], width), size + 1) for c in range(3)], 1)[:size]
    both = mask[:, 1:]
    real, pairs = count(one[y[mask]]), np.zeros((3, 3))
    np.add.at(pairs, (y[:, :-1][both], y[:, 1:][both]), 1)
    np.add.at(pairs, (np.zeros(n, int), y[:, 0]), 1)
    ends = mask.sum(1) - 1
    np.add.at(pairs, (y[np.arange(n), ends], np.zeros(n, int)), 1)
    weights, moves = np.zeros((size + 1, 3)), np.zeros((3, 3))
    allowed = np.ones((3, 3), bool)
    allowed[OUTSIDE, INSIDE] = False
    first, second = np.zeros((size + 3, 3)), np.zeros((size + 3, 3))
    for step in range(1, steps + 1):
        emit = np.zeros((n, longest, 3))
        emit[mask] = weights[flat].sum(1)
        move = np.where(allowed, moves, -1e4)
        fore, back = np.zeros((n, longest, 3)), np.zeros((n, longest, 3))
        fore[:, 0] = move[OUTSIDE] + emit[:, 0]
        for t in range(1, longest):
            fore[:, t] = _logsum(fore[:, t - 1, :, None] + move, 1) + emit[:, t]
        back[np.arange(n), ends] = move[:, OUTSIDE]
        for t in range(longest - 2, -1, -1):
            later = _logsum(move + (emit[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(mask[:, t + 1, None], later, back[:, t])
        total = _logsum(fore[np.arange(n), ends] + move[:, OUTSIDE], 1)
        p = np.exp(fore + back - total[:, None, None])
        pair = np.exp(fore[:, :-1, :, None] + move + (emit[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None])[both].sum(0)
        pair[OUTSIDE] += p[:, 0].sum(0)
        pair[:, OUTSIDE] += p[np.arange(n), ends].sum(0)
        slope = np.concatenate([count(p[mask]) - real, np.where(allowed, pair - pairs, 0)]) / n + ridge * np.concatenate([weights[:size], moves])
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        change = 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        weights[:size] -= change[:size]
        moves -= change[size:]
    return Tagger({f: weights[k] for f, k in index.items()}, moves)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


class _Maker:
    """Makes texts with secrets at known places."""

    SYLLABLES = "ra to li en mo su ka ne the er in on st re an ed ing tion que los les cion ach ung eit éa ñi ü ß о на 東".split()
    HEX, UPPER9 = "0123456789abcdef", string.ascii_uppercase + "234567"
    ALNUM = string.ascii_letters + string.digits

    def __init__(self, rng: random.Random):
        self.rng = rng

    def word(self) -> str:
        rng = self.rng
        word = "".join(rng.choice(self.SYLLABLES) for _ in range(rng.randint(1, 5)))
        kind = rng.random()
        return word.capitalize() if kind < 0.12 else word.upper() if kind < 0.16 else word

    def prose(self, low: int = 2, high: int = 14) -> str:
        words = [self.word() + self.rng.choice(["", "", "", "", ",", ".", "!!", ":"]) for _ in range(self.rng.randint(low, high))]
        return " ".join(words)

    def draw(self, letters: str, low: int, high: int) -> str:
        return "".join(self.rng.choice(letters) for _ in range(self.rng.randint(low, high)))

    def secret(self) -> str:
        """What is secret wherever it stands."""
        rng, draw = self.rng, self.draw
        return rng.choice([
            lambda: "AKIA" + draw(self.UPPER9, 16, 16), lambda: draw(self.HEX, 32, 64), lambda: draw(self.ALNUM, 28, 44), lambda: "ghp_" + draw(self.ALNUM, 36, 36),
            lambda: f"sk_{rng.choice(['live', 'test'])}_" + draw(self.ALNUM, 24, 32), lambda: "sk-" + draw(self.ALNUM, 32, 48), lambda: "glpat-" + draw(self.ALNUM, 20, 20),
            lambda: f"xoxb-{draw(string.digits, 11, 12)}-{draw(string.digits, 11, 12)}-{draw(self.ALNUM, 24, 24)}", lambda: "AIza" + draw(self.ALNUM + "-_", 35, 35),
            lambda: f"eyJ{draw(self.ALNUM, 20, 40)}.eyJ{draw(self.ALNUM, 30, 60)}.{draw(self.ALNUM + '-_', 30, 43)}", lambda: draw(self.ALNUM + "+/", 40, 40), lambda: draw(self.ALNUM + "+/", 42, 62) + "==",
        ])()

    def weak(self) -> str:
        """What is secret only where something says so."""
        rng, draw = self.rng, self.draw
        return rng.choice([lambda: draw(self.HEX, 8, 24), lambda: draw(self.ALNUM, 8, 20), lambda: self.word() + draw(string.digits, 1, 4) + rng.choice("!#$%"), lambda: draw(self.ALNUM, 12, 24), lambda: self.word().capitalize() + draw(string.digits, 3, 5), self.secret])()

    def harmless(self) -> str:
        rng, draw = self.rng, self.draw
        number = lambda low, high: draw(string.digits, low, high)
        return rng.choice([
            lambda: f"{self.word()}.{number(1, 3)}@mail{number(1, 1)}.example.com", lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)), lambda: number(13, 19), lambda: f"+{number(1, 3)} {number(3, 4)} {number(5, 8)}", lambda: f"+{number(1, 2)}-{number(3, 3)}-{number(3, 3)}-{number(4, 4)}",
            lambda: f"https://{self.word()}.org/{self.word()}/{self.word()}-{number(1, 6)}.html", lambda: f"{number(4, 4)}-{number(2, 2)}-{number(2, 2)}T{number(2, 2)}:{number(2, 2)}", lambda: f"v{number(1, 2)}.{number(1, 2)}.{number(1, 3)}", lambda: f"commit {draw(self.HEX, 7, 10)}",
            lambda: f"{draw(self.HEX, 8, 8)}-{draw(self.HEX, 4, 4)}-{draw(self.HEX, 4, 4)}-{draw(self.HEX, 4, 4)}-{draw(self.HEX, 12, 12)}", lambda: f"#{draw(self.HEX, 6, 6)}", lambda: f"get{self.word().capitalize()}For{self.word().capitalize()}({self.word()}, {number(1, 3)});", lambda: f"{self.word()}_{self.word()} = {number(1, 5)}",
            lambda: f"{self.word()}={self.word()}", lambda: f"ISBN 978-{number(1, 1)}-{number(3, 5)}-{number(3, 4)}-{number(1, 1)}", lambda: f"SPDX-License-Identifier: {self.word()}-{number(1, 1)}.0", lambda: f"the {rng.choice(['password', 'token', 'secret', 'key', 'api key', 'session'])} {self.word()} {self.word()}", lambda: f"{rng.choice(['tokens', 'keys', 'Password'])}: {number(1, 4)}", lambda: f"{self.word().upper()}{number(1, 4)}", lambda: "=" * rng.randint(3, 40), lambda: "-" * rng.randint(3, 40), lambda: " ".join(rng.choice([self.word(), self.word(), number(4, 16)]) + rng.choice("#$%&*") * 3 for _ in range(rng.randint(1, 8))), lambda: self.prose() + "!!",
            lambda: "".join(self.word().lower() for _ in range(5)), lambda: "".join(self.word().upper() for _ in range(5)), lambda: f"{number(3, 3)}-{number(2, 2)}-{number(4, 4)}", lambda: f"{draw(string.ascii_uppercase, 2, 2)}{number(2, 2)} {number(4, 4)} {number(4, 4)} {number(4, 4)}",
        ])()

    def assignment(self) -> tuple[str, str, str]:
        """What stands before, the secret, what stands after it."""
        rng = self.rng
        key = rng.choice(["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "API_KEY", "client_secret", "access_token", "SECRET_KEY", "Passwort", "contraseña", "auth_token", "DB_PASSWORD", "private_key", "passphrase", "Kennwort", "aws_secret_access_key"])
        quote = rng.choice(["", "", '"', "'"])
        return rng.choice([
            (f"{key}{rng.choice(['=', ' = ', ': ', ':', ' := ', ' => '])}{quote}", self.weak(), quote), (f'"{key}": "', self.weak(), '",'), ("Authorization: Bearer ", self.weak(), ""), (f"https://{self.word()}:", self.weak(), f"@{self.word()}.example.com/"),
            (f"--{key} ", self.weak(), ""), (f"<{key}>", self.weak(), f"</{key}>"), (f"postgres://{self.word()}:", self.weak(), "@db.example.com:5432/x"), (f"your {key} is ", self.weak(), "."),
        ])

    def text(self) -> tuple[str, list[tuple[int, int]]]:
        rng, out, spans = self.rng, "", []
        code = rng.random() < 0.3
        for _ in range(rng.randint(1, 5)):
            out += rng.choice([self.prose(), self.prose(), self.harmless()]) if not code else self.harmless()
            out += rng.choice(["\n", "\n", " "] if code else [" ", " ", " ", "\n"])
            kind = rng.random()
            if kind < 0.25:
                before, secret, after = self.assignment() if kind < 0.15 else (rng.choice(["", "", '"', "("]), self.secret(), rng.choice(["", "", ",", "."]))
                spans.append((len(out) + len(before), len(out) + len(before) + len(secret)))
                out += before + secret + after + rng.choice([" ", " ", "\n"])
            elif kind < 0.6:
                out += self.harmless() + rng.choice([" ", "\n", ". "])
        return out + self.prose(0, 4), spans


def labelled_texts(n: int = 1500, seed: int = 11) -> list[tuple[str, list[tuple[int, int]]]]:
    """``n`` made texts with the spans of their secrets."""
    return [_Maker(random.Random(seed * 1_000_003 + k)).text() for k in range(n)]


def all_spans(base: list[tuple[int, int, str]], tagged: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """The base spans and those tagged ones that overlap none of them, by start, then kind."""
    rank = {kind: k for k, (kind, *_) in enumerate(KINDS)}
    own = [(a, b, TAGGED) for a, b in tagged if not any(a < d and c < b for c, d, _ in base)]
    return sorted(base + own, key=lambda s: (s[0], rank.get(s[2], len(rank)), s[1]))


def secrets(docs: DataFrame, tagger: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans (array of start, end, kind) of each row of ``docs``, by start: those of the patterns (KINDS) and of the chain (TAGGED,
    where no pattern's span overlaps). Places are code points, ends exclusive. No shuffle.

    A null text is empty; repeated rows get a row each; an empty table gives an empty result; other columns are not read. A text
    is one row, so it must fit a task; its memory is some 60 bytes a token while it is tagged.
    """
    chain = tagger or fit(labelled_texts())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def chunk(texts: list[str], held: dict) -> list:
        if held.get("of") is not chain:
            held.update(of=chain, types=chain.types())
        held["types"].rest()
        out = []
        for text, labels in zip(texts, chain.tags(texts, held["types"])):
            spans = all_spans(base_spans(text), chain.spans(text, labels))
            out.append([{"start": a, "end": b, "kind": k} for a, b, k in spans])
        return out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("secrets")
        held = HELD.setdefault("secrets", {})
        for batch in batches:
            found, texts, chars = [], [], 0
            for value in batch.column(1).cast(pa.binary()):
                texts.append((value.as_py() or b"").decode("utf-8", "replace"))
                chars += len(texts[-1])
                if chars >= CHUNK_CHARS:
                    found += chunk(texts, held)
                    texts, chars = [], 0
            found += chunk(texts, held) if texts else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=[id_col, "spans"])

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, spans array<struct<start:long,end:long,kind:string>>"
    return docs.select(id_col, text_col).mapInArrow(scan, schema)


def _of_kind(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def _listed(spans) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    base = _listed(F.filter("spans", lambda s: s["kind"] != TAGGED))
    counts = [_of_kind(kind).alias(f"n_{kind}") for kind, *_ in KINDS]
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
