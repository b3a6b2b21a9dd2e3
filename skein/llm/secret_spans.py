"""Secrets in whole texts: fixed patterns, and spans that a linear-chain conditional random field adds."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: The base patterns. Runs of hexadecimal digits and access keys are maximal, so their least lengths can stand in the pattern.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "crf")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Documents, about, from which the field is learned at most, and its training.
SAMPLE_ROWS, WINDOW, EPOCHS, RATE, L2 = 1200, 8, 70, 0.5, 1e-3
#: Tokens whose own score prefers O by more than this are O before the rest is decoded.
LEAD = 6.0
#: A span is added if the chance that its tokens are no secret is at most this.
DOUBT = 0.2
O, B, I = 0, 1, 2

_WORD_HINT = re.compile(r"pass|pwd|secret|token|key|auth|cred|bearer|private|login", re.A)
_ATTRIBUTES = 26
_RUNS, _FILE_NAME, _HEX_OR_NUMBER = re.compile(r"[A-Za-z0-9]+"), re.compile(r"\w\.[a-z]{2,4}$", re.A), re.compile(r"[0-9a-f]+|[0-9A-F]+|[0-9]+[A-Z]?|[A-Z][0-9]+")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and non-overlapping within a kind; by start, then kind as listed."""
    low, out = text.lower(), []
    if any(n in low for n in _NAMES):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def attributes(token: str) -> int:
    """A token's shape as bits: character classes, length, variety and name hints."""
    bare = token.strip("\"'`,;()[]{}<>.")
    n = len(bare)
    digits, lowers, uppers = sum(map(str.isdigit, bare)), sum(map(str.islower, bare)), sum(map(str.isupper, bare))
    kinds = (digits > 0) + (lowers > 0) + (uppers > 0)
    counts = [bare.count(c) / n for c in set(bare)] if n else []
    entropy = -sum(p * math.log2(p) for p in counts)
    core = bare.rsplit("=", 1)[-1] if "=" in bare[:-2] else bare
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(core, core[1:], strict=False))
    hexes = n > 0 and all(c in "0123456789abcdefABCDEF" for c in core)
    runs = _RUNS.findall(bare)
    longest = max(runs, key=len, default="")
    facts = (
        True, n == 0, token in ("=", ":", ":=", "=>"), token[-1:] in ("=", ":"), "=" in bare[:-1] or ":" in bare[:-1], token[:1] in "\"'`",
        bool(_WORD_HINT.search(token.lower())), n >= 8, n >= 16, n >= 24, n >= 40, kinds >= 2 and digits > 0, kinds == 3, digits == n > 0,
        entropy > 2.8, entropy > 3.4, changes >= 4, hexes and digits > 0, "@" in bare or "/" in bare, uppers > 1 and digits > 0 and not lowers,
        len(runs) >= 3 and len(longest) <= 12, digits * 10 >= 6 * sum(map(len, runs)) > 0, len(longest) >= 16, len(longest) >= 12 and any(map(str.isdigit, longest)) and not longest.isdigit(), bool(_FILE_NAME.search(bare)), all(map(_HEX_OR_NUMBER.fullmatch, runs)),
    )
    return sum(1 << k for k, on in enumerate(facts) if on)


#: A token is odd if it is long, or has a digit or an inner mark.
_ODD_LENGTH, _ODD_MARK = 24, re.compile(r"\d|[=:_/+-]\w|^[=:]+$")


def file_bits(tokens: list[str], odd: int) -> int:
    """Features of the whole file: any odd token, many of them, and a long file."""
    return 1 | (odd > 0) << 1 | (odd * 20 > len(tokens)) << 2 | (len(tokens) > 2000) << 3


_FILE = 4
_PLACES = 5  # the token itself, the two before it and the two after
WIDTH = _ATTRIBUTES * _PLACES + _FILE


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    return ((values[..., None] >> np.arange(width)) & 1).astype(np.float64)


def inputs(shapes: np.ndarray, files: np.ndarray) -> np.ndarray:
    """(windows, inner tokens, WIDTH) features; shapes have two tokens more on each side."""
    n = shapes.shape[1] - 4
    parts = [_bits(shapes[:, 2 + d : 2 + d + n], _ATTRIBUTES) for d in (0, -1, -2, 1, 2)]
    return np.concatenate([*parts, np.repeat(_bits(files, _FILE)[:, None], n, axis=1)], axis=2)


@dataclass
class Field:
    """Weights of tag scores by feature, and of a tag after another."""

    weights: np.ndarray
    moves: np.ndarray

    def decode(self, scores: np.ndarray) -> list[int]:
        """Viterbi over (tokens, 3), with O before and after."""
        best, back = self.moves[O] + scores[0], []
        for s in scores[1:]:
            step = best[:, None] + self.moves
            back.append(step.argmax(0))
            best = step.max(0) + s
        tag = int((best + self.moves[:, O]).argmax())
        out = [tag]
        for b in reversed(back):
            out.append(tag := int(b[tag]))
        return out[::-1]

    def doubt(self, scores: np.ndarray) -> np.ndarray:
        """The chance of O for each of (tokens, 3), with O before and after."""
        a = np.empty_like(scores)
        z = np.zeros_like(scores)
        a[0] = self.moves[O] + scores[0]
        for t in range(1, len(scores)):
            a[t] = _sum(a[t - 1][:, None] + self.moves, 0) + scores[t]
        z[-1] = self.moves[:, O]
        for t in range(len(scores) - 2, -1, -1):
            z[t] = _sum(self.moves + (scores[t + 1] + z[t + 1])[None], 1)
        total = a + z
        return np.exp(total[:, O] - _sum(total, 1))


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    """The logarithm of the sum of exponentials."""
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def learn(shapes: np.ndarray, files: np.ndarray, tags: np.ndarray) -> Field:
    """Gradient ascent on the likelihood of tagged windows, by the forward-backward sums of all windows at once. I never follows O."""
    x = inputs(shapes, files)
    w, moves = np.zeros((WIDTH, 3)), np.zeros((3, 3))
    n, steps = tags.shape
    gold = np.eye(3)[tags]
    blocked = np.zeros((3, 3))
    blocked[O, I] = -50.0
    sw, sm = np.full_like(w, 1e-8), np.full_like(moves, 1e-8)

    for _ in range(EPOCHS if n else 0):
        m, s = moves + blocked, x @ w
        a, z = np.empty_like(s), np.zeros_like(s)
        a[:, 0] = s[:, 0] + m[O]
        for t in range(1, steps):
            a[:, t] = _sum(a[:, t - 1][:, :, None] + m, 1) + s[:, t]
        z[:, -1] = m[:, O]
        for t in range(steps - 2, -1, -1):
            z[:, t] = _sum(m[None] + (s[:, t + 1] + z[:, t + 1])[:, None, :], 2)
        total = _sum(a[:, -1] + z[:, -1], 1)[:, None, None]
        chance = np.exp(a + z - total)
        pair = np.exp(a[:, :-1, :, None] + m + (s + z)[:, 1:, None, :] - total[..., None])
        gw = x.reshape(-1, WIDTH).T @ (gold - chance).reshape(-1, 3) / n - L2 * w
        gm = (np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:]) - pair.sum((0, 1))) / n - L2 * moves
        sw += gw * gw
        sm += gm * gm
        w += RATE * gw / np.sqrt(sw)
        moves += RATE * gm / np.sqrt(sm)
    return Field(w, moves + blocked)


def _odd(tokens: list[str]) -> list[int]:
    """Places of tokens that are no plain words."""
    return [i for i, t in enumerate(tokens) if not t.isalpha() and _ODD_MARK.search(t) or len(t) >= _ODD_LENGTH]


_CACHE: dict[str, int] = {}


def _shape(token: str) -> int:
    found = _CACHE.get(token)
    if found is None:
        if len(_CACHE) > 200_000:
            _CACHE.clear()
        found = _CACHE[token] = attributes(token)
    return found


#: What made secrets are made of, so that the field doesn't learn the corpus' own kinds alone: alphabets, beginnings, names and contexts. In a context the first token of a secret is marked by < and the others by >.
_ALPHABETS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
_BEGINNINGS = ("", "", "", "", "sk_live_", "ghp_", "xoxb-", "eyJ", "glpat-", "SG.", "hf_", "pk-")
_MADE_NAMES = ("pwd", "auth", "credential", "credentials", "private_key", "login", "access_key", "passphrase", "key", "client_secret", "auth_token", "pass", "bearer")
_CONTEXTS = ("<{n}={v}", "<{n}: >{v}", "<{n} >= >{v}", '<{n}="{v}"', "{n} is <{v}", "the {n} is <{v}", "export <{N}={v}", "bearer <{v}", "Bearer <{v}", "--{n} <{v}", "my {w} {n}: <{v}", "{w} <{v} {w}", "{n} <{v}")
#: Odd tokens that are no secrets, and names of secrets with plain words after them.
_HARMLESS = ("20{d}-0{e}-1{e}", "{d},{d}{e}.{e}0", "user{d}@example.com", "https://example.com/{w}/{d}?page={e}", "v{e}.{e}.{d}", "+49-{d}-{d}{d}{d}", "({d}", "{w}-{w}", "{n} is {w}", "{n}: {w} {w}", "the {n} {w}", "{w}={w}", "{d}/{d}", "{w}_{w}", "{N}", "#{d}{e}", "{d}:{d}:{d}", "{w}:{d}{d}", "id={d}{d}{e}", "src/{w}/{w}_{e}.py")
#: More of them, in which %d3 stands for three drawn digits, %h for hexadecimal digits, %U for capitals.
_HARMLESS_DRAWN = ("20%d2-%d2-%d2T%d2:%d2:%d2Z", "%h8-%h4-%h4-%h4-%h12", "({w}, %h8-%h4-%h4-%h4-%h12)", "%U2%d20", "10.%d4/%h6.%d4", "%U3-%d4", "%d3-%d1-%d2-%d6-%d1", "commit %h7", "%d3.%d2.%d1.%d3", "v%d1.%d1.%d2-rc%d1", "report_20%d6_v%d1.pdf", "%h2-%h2-%h2-%h2", "#%h6", "{w}%d2.{w}", "https://example.org/%d6/{w}-{w}-%d4.html", "%U1%d7", "{w}-{w}-%d3-{w}", "%d2h%d2m%d2s", "%d4:%d4:%h4", "{w}.{w}.{w}%d1")
_DRAWN = re.compile(r"%([dhU])(\d+)")
_DRAWN_FROM = {"d": "0123456789", "h": "0123456789abcdef", "U": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _made(draw: random.Random, tokens: list[str], harmless: bool) -> list[tuple[str, int]]:
    """Tokens with tags: a made secret in a context, or what only looks like one."""
    word = lambda: draw.choice(tokens) if tokens else "word"
    value = draw.choice(_BEGINNINGS) + "".join(draw.choices(draw.choice(_ALPHABETS), k=draw.choice((draw.randint(10, 18), draw.randint(10, 44)))))
    if not any(c.isdigit() for c in value):
        value += str(draw.randint(10, 99))
    name = draw.choice(_MADE_NAMES)
    form = draw.choice((*_HARMLESS, *_HARMLESS_DRAWN) if harmless else _CONTEXTS)
    text = form.format(n=name, N=name.upper(), v=value, w=word(), d=draw.randint(10, 99), e=draw.randint(0, 9))
    text = _DRAWN.sub(lambda m: "".join(draw.choices(_DRAWN_FROM[m[1]], k=int(m[2]))), text) if harmless else text
    return [(t.lstrip("<>") if not harmless else t, 0 if harmless else B if t[0] == "<" else I if t[0] == ">" else O) for t in text.split()]


def _tagged(text: str) -> list[tuple[list[int], int, list[int]]]:
    """Windows of a document with tags: around base spans and odd tokens outside them, drawn from all of them, and around made secrets and harmless tokens that are put in."""
    found = list(re.finditer(r"\S+", text))
    tokens = [m[0] for m in found]
    tags, k = [O] * len(tokens), 0
    for _, start, end in base_spans(text):
        first = True
        while k < len(found) and found[k].end() <= start:
            k += 1
        for j in range(k, len(found)):
            if found[j].start() >= end:
                break
            if tags[j] == O:
                tags[j] = B if first else I
            first = False
    odd = _odd(tokens)
    draw = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    marked, plain = [i for i, t in enumerate(tags) if t == B], [i for i in odd if tags[i] == O]
    cases = [(c, tokens, tags) for c in (*draw.sample(marked, min(2, len(marked))), *draw.sample(plain, min(2, len(plain))), *draw.sample(range(len(tokens)), min(1, len(tokens))))]
    for harmless in (False, False, False, True, True):
        new = _made(draw, tokens[:200], harmless)
        at = draw.randint(0, len(tokens))
        if at == len(tokens) or tags[at] != I:
            cases.append((at + draw.randrange(len(new)), [*tokens[:at], *(t for t, _ in new), *tokens[at:]], [*tags[:at], *(t for _, t in new), *tags[at:]]))
    out = []
    for c, here, own in cases:
        at = range(c - WINDOW - 2, c + WINDOW + 3)
        inner = [own[i] if 0 <= i < len(own) else O for i in at[2:-2]]
        if inner[0] != I:
            out.append(([_shape(here[i]) if 0 <= i < len(here) else 0 for i in at], file_bits(tokens, len(odd)), inner))
    return out


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Field:
    """Learn from about sample_rows documents at most, drawn by a hash of the id: windows of base spans, made secrets and other tokens.

    What reaches the driver are windows of numbers, at most ten for a document.
    """
    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).filter(text.isNotNull())
    share = min(1.0, sample_rows / max(1, docs.count()))
    drawn = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1_000_000)) < int(1_000_000 * share) if share < 1 else F.lit(True))

    def cut(batches):
        for b in batches:
            out = [(i, *w) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w in _tagged(t)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.list_(pa.int32()))], names=["doc_id", "shapes", "bits", "tags"])

    found = drawn.select("doc_id", "text").mapInArrow(cut, "doc_id long, shapes array<long>, bits int, tags array<int>").toPandas()
    found = found.assign(key=[tuple(s) for s in found["shapes"]]).sort_values(["doc_id", "key"], kind="stable", na_position="first")
    length = 2 * WINDOW + 1
    shapes = np.array(found["shapes"].tolist(), dtype=np.int64).reshape(-1, length + 4)
    return learn(shapes, found["bits"].to_numpy(dtype=np.int64), np.array(found["tags"].tolist(), dtype=np.int64).reshape(-1, length))


def field_spans(text: str, field: Field) -> list[tuple[int, int]]:
    """(start, end) of token runs that Viterbi tags as secrets, without those that touch base spans or stay in doubt.

    Tokens with no odd token within two places, and those whose own score prefers O by
    more than LEAD, are O; Viterbi decodes the parts between them.
    """
    tokens = text.split()
    odd = _odd(tokens)
    if not odd:
        return []
    bits = file_bits(tokens, len(odd))
    near = sorted({j for i in odd for j in range(max(0, i - 2), min(len(tokens), i + 3))})
    shape = {j: _shape(tokens[j]) for i in near for j in range(max(0, i - 2), min(len(tokens), i + 3))}
    around = np.array([[shape.get(i + d, 0) for d in (0, -1, -2, 1, 2)] for i in near], dtype=np.int64)
    x = np.concatenate([_bits(around, _ATTRIBUTES).reshape(len(near), -1), np.repeat(_bits(np.array([bits]), _FILE), len(near), axis=0)], axis=1)
    scores = x @ field.weights
    open_ = scores[:, O] - scores[:, 1:].max(axis=1) <= LEAD
    spans: list[tuple[int, int]] = []
    run: list[int] = []
    for k in [*np.nonzero(open_)[0].tolist(), -1]:
        if run and (k < 0 or near[k] != near[run[-1]] + 1):
            part = scores[run]
            tags, doubt = field.decode(part), field.doubt(part)
            for at, tag in enumerate(tags):
                if tag == B or tag == I and (at == 0 or tags[at - 1] == O):
                    end = at
                    while end + 1 < len(tags) and tags[end + 1] == I:
                        end += 1
                    if doubt[at : end + 1].max() <= DOUBT:
                        spans.append((near[run[at]], near[run[end]]))
            run = []
        if k >= 0:
            run.append(k)
    if not spans:
        return []
    places = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    return [(places[a][0], places[b][1]) for a, b in spans]


def all_spans(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of a text; the field's own have the kind `crf` and none of them overlaps a base span."""
    base = base_spans(text)
    added = [("crf", a, b) for a, b in field_spans(text, field) if not any(s < b and a < e for _, s, e in base)]
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def find_secrets(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each document, of its whole text.

    Offsets are code points, ends exclusive. Base spans are those of the fixed patterns;
    the field, learned from a sample of the documents unless given, adds spans of kind
    `crf`. Null and empty texts have no spans and the digest of an empty string. Rows
    that repeat give a row each, a null doc_id stays null, no rows give no rows; other
    columns are ignored.
    """
    small_batches(docs.sparkSession)
    model = train(docs) if field is None else field

    def run(batches):
        for b in batches:
            out: dict[str, list] = {n: [] for n in _OUT.names}
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                base, spans = all_spans(text or "", model)
                kinds = [k for k, _, _ in base]
                row = (doc_id, *(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans))
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=_OUT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
