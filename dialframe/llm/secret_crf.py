"""Secret scan: fixed base patterns and a linear-chain conditional random field.

Each line is a sequence of tokens, tagged begin / inside / outside of a secret.
Features are a token's shape, length, entropy and word, the words and shapes of
its neighbours, and features of the whole text (share of tokens with digits,
length); weights are hashed to :data:`DIMS` rows.  The best tags are found by
Viterbi, over all lines of a batch at once.

The field is trained on lines of at most ``max_train_docs`` documents (the first
by hash among those with an assignment or access key, and as many among all), cut to
:data:`TRAIN_TOKENS` tokens around their secrets; the base patterns give the
tags.  Scanning covers every document and its whole text.

Base spans always stay; spans of the field (kind ``crf``) are added where they
do not overlap a base span.  Defined results: a null or empty text has no span;
repeated rows are scanned each; without a base match in the table there is no
field and only base spans are returned; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialframe.llm.common import map_batches, pick, slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # AKIA[A-Z0-9]+ of 20 or more characters
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
MIN_VALUE = 6
#: A text without these cannot match ASSIGN.
_NAMES = ("passw", "secret", "token", "apikey", "api_key")
#: An assignment, for the training sample only.
_ASSIGNED = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6}"

TOKEN = re.compile(r"[\w+/.-]+|[^\w\s+/.-]")
DIMS = 1 << 13
MAX_TRAIN_DOCS = 600
TRAIN_TOKENS = 48
O, B, I = 0, 1, 2
#: Added to the score of "outside" when decoding: a doubtful token stays text.
MARGIN = 1.0
_CACHE_TOKENS = 200_000


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base matches, by start, then kind as listed."""
    if not text:
        return []
    out = []
    small = text.lower()
    if any(n in small for n in _NAMES):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def secret_values(text: str) -> list[tuple[int, int]]:
    """Character ranges of the secrets themselves: the value of an assignment, a key, a hex run."""
    out = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    out += [m.span() for p in (ACCESS, HEX) for m in p.finditer(text)]
    merged: list[list[int]] = []
    for s, e in sorted(out):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    return [(s, e) for s, e in merged]


def _shape(token: str) -> str:
    if token.islower() and token.isalpha():
        return "a"
    if token.istitle() and token.isalpha():
        return "Aa"
    kinds = ""
    for c in token[:64]:
        k = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        if not kinds.endswith(k):
            kinds += k
    return kinds[:12]


def token_features(token: str, vocabulary: frozenset[str]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(features of the token itself, features it gives its neighbours).

    Only words of the training lines have a feature of their own, so distinct tokens share few feature sets.
    """
    n = len(token)
    small = token.lower()
    word = "w:" + small if small in vocabulary else "w:?"
    shape = "s:" + _shape(token)
    length = f"n:{n if n < 8 else 8 * min(n // 8, 6)}"
    near = (word, shape, length)
    if token.isalpha() and n < 24:
        return near + ("d:0",), near
    share = f"/d:{min(4, 5 * sum(map(str.isdigit, token)) // n)}"
    own = near + (share[1:], length + share)
    if n >= 8:
        own += (f"e:{8 * len(set(token)) // n}", f"x{not token.strip('0123456789abcdef')}", f"u{token.isupper()}")
    return own, near


def _ids(prefix: str, names) -> list[int]:
    return [1 + zlib.crc32((prefix + n).encode("utf-8", "surrogatepass")) % (DIMS - 1) for n in names]


def file_features(n_tokens: int, n_digits: int) -> list[int]:
    """Features of a whole text: how long it is and what share of its tokens hold digits."""
    return _ids("f:", [f"n{min(12, n_tokens.bit_length())}", f"d{min(5, 20 * n_digits // max(1, n_tokens))}"])


@dataclass(frozen=True)
class Field:
    """Emission weights (row 0 is padding), transitions [from, to], start scores, and the words known."""

    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray
    vocabulary: frozenset[str]


_NEVER = -1e4


def _masked(moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inside follows begin or inside only."""
    moves, start = moves.copy(), start.copy()
    moves[O, I] = start[I] = _NEVER
    return moves, start


def viterbi(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """Best tags of each sequence; ``scores`` holds them one after another (tokens x 3)."""
    order = np.argsort(-lengths, kind="stable")
    begins = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    moves, start = _masked(moves, start)
    back, best = [], scores[begins] + start
    final = np.empty_like(best)
    for t in range(1, int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -t, side="left"))  # sequences longer than t
        final[live:len(best)] = best[live:]
        paths = best[:live, :, None] + moves[None]
        back.append(paths.argmax(1).astype(np.int8))
        best = paths.max(1) + scores[begins[:live] + t]
    final[:len(best)] = best
    tags = final.argmax(1)
    flat = np.zeros(len(scores), np.int8)
    for t in range(len(back), -1, -1):
        live = int(np.searchsorted(-sizes, -t, side="left"))
        flat[begins[:live] + t] = tags[:live]
        if t:
            tags[:live] = back[t - 1][np.arange(live), tags[:live]]
    return np.split(flat, np.cumsum(lengths)[:-1])


class Tagger:
    """Scores tokens with a field, each distinct token's features once."""

    def __init__(self, field: Field):
        self.field = field
        self._reset()

    def _reset(self) -> None:
        self._known: dict[str, int] = {}
        self._sets: dict[tuple, int] = {}
        self._table = np.zeros((1024, 13), np.float32)

    def _set_number(self, token: str) -> int:
        """Row of the token's feature set in the table of scores."""
        digits = not token.isalpha() and any(map(str.isdigit, token))
        own, near = token_features(token, self.field.vocabulary)
        key = (own, digits)
        if key not in self._sets:
            if len(self._sets) == len(self._table):
                self._table = np.concatenate([self._table, np.zeros_like(self._table)])
            w = self.field.weights
            parts = [w[_ids(p, names)].sum(0) for p, names in (("o:", own), ("p:", near), ("q:", near), ("r:", near))]
            self._table[len(self._sets)] = np.concatenate([*parts, [digits]])
            self._sets[key] = len(self._sets)
        return self._sets[key]

    def numbers(self, tokens: list[str]) -> np.ndarray:
        if len(self._known) > _CACHE_TOKENS:
            self._reset()
        known = self._known
        for t in set(tokens).difference(known):
            known[t] = self._set_number(t)
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))

    def tag(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Character ranges that the field tags as secrets, per text."""
        tokens, lengths, where = [], [], []
        for i, text in enumerate(texts):
            at = 0
            for line in text.split("\n"):
                found = TOKEN.findall(line)
                if found:
                    tokens += found
                    lengths.append(len(found))
                    where.append((i, at, line))
                at += len(line) + 1
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not tokens:
            return spans
        size = np.array(lengths)
        numbers = self.numbers(tokens)
        row = self._table[numbers]
        doc = np.repeat([w[0] for w in where], size)
        line = np.repeat(np.arange(len(size)), size)
        scores = row[:, :3].astype(np.float64)
        for shift, cols, back in ((1, slice(3, 6), True), (2, slice(6, 9), True), (1, slice(9, 12), False)):
            if len(row) > shift:
                same = (line[shift:] == line[:-shift])[:, None]
                if back:
                    scores[shift:] += np.where(same, row[:-shift, cols], 0)
                else:
                    scores[:-shift] += np.where(same, row[shift:, cols], 0)
        n, d = np.bincount(doc, minlength=len(texts)), np.bincount(doc, weights=row[:, 12], minlength=len(texts))
        w = self.field.weights
        scores += np.array([w[file_features(int(a), int(b))].sum(0) for a, b in zip(n, d)])[doc]
        scores[:, O] += MARGIN
        # A line whose every token loses by more than the moves can give back is all "outside": no search needed.
        moves, start = _masked(self.field.moves, self.field.start)
        gain = 2 * max(0.0, float(moves.max() - moves[O, O]), float(start.max() - start[O]))
        close = np.maximum(scores[:, B], scores[:, I]) - scores[:, O] + gain > 0
        lines = np.flatnonzero(np.bincount(line, weights=close, minlength=len(size)) > 0)
        if not len(lines):
            return spans
        picked = np.isin(line, lines)
        for k, tags in zip(lines, viterbi(scores[picked], size[lines], self.field.moves, self.field.start)):
            if tags.any():
                i, at, content = where[k]
                spans[i] += [(at + s, at + e) for s, e in _runs(content, tags)]
        return spans


def _runs(line: str, tags: np.ndarray) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for m, t in zip(TOKEN.finditer(line), tags):
        if t == B:
            out.append(m.span())
        elif t == I and out:
            out[-1] = (out[-1][0], m.end())
    return out


def _train_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token windows with their tags: around every secret of a document, and its first and last lines."""
    for b in slices(batches, "text"):
        rows = []
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            all_tokens = TOKEN.findall(text or "")
            file = (len(all_tokens), sum(any(c.isdigit() for c in t) for t in all_tokens))
            lines = [x for x in (text or "").split("\n") if TOKEN.search(x)]
            marked = [k for k, x in enumerate(lines) if secret_values(x)][:6]
            for k in sorted({*marked, *range(min(2, len(lines))), *range(max(0, len(lines) - 2), len(lines))}):
                found, values = list(TOKEN.finditer(lines[k])), secret_values(lines[k])
                tags = []
                for m in found:
                    over = [v for v in values if m.start() < v[1] and m.end() > v[0]]
                    tags.append(O if not over else I if tags and tags[-1] != O and m.start() > over[0][0] else B)
                centre = next((i for i, t in enumerate(tags) if t == B), 0)
                lo = max(0, centre - TRAIN_TOKENS // 2)
                part = slice(lo, lo + TRAIN_TOKENS)
                rows.append((doc, k, [m[0][:200] for m in found[part]], tags[part], *file))
        cols = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.string())),
             pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int64())],
            names=["doc_id", "line", "tokens", "tags", "n_tokens", "n_digits"])


def training_lines(docs: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> list:
    """Tagged lines of a bounded sample of documents, in a fixed order."""
    rows = pick(docs, doc_id="doc_id", text="text")
    ids = rows.where(F.col("doc_id").isNotNull())

    def first(df: DataFrame) -> DataFrame:
        return df.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_docs)

    named = F.lit(False)
    for n in _NAMES:  # plain searches spare most texts the pattern
        named = named | F.contains(F.lower("text"), F.lit(n))
    likely = F.when(named, F.col("text").rlike(_ASSIGNED)).otherwise(
        F.when(F.contains("text", F.lit("AKIA")), F.col("text").rlike("AKIA[A-Z0-9]{16}")))
    sample = first(ids.where(likely)).union(first(ids)).distinct()
    texts = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    schema = ("doc_id long, line long, tokens array<string>, tags array<long>, n_tokens long, n_digits long")
    got = map_batches(texts, _train_lines, schema).collect()
    return sorted(got, key=lambda r: (r.doc_id, r.line))


def known_words(lines: list) -> frozenset[str]:
    """Words seen twice or more in the training lines."""
    seen = Counter(t.lower() for r in lines for t in r.tokens if len(t) <= 12 and not any(map(str.isdigit, t)))
    return frozenset(w for w, n in seen.items() if n > 1)


def _padded(lines: list, vocabulary: frozenset[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids (lines x tokens x features), tags and lengths, padded with zeros."""
    cache: dict[str, tuple] = {}
    rows = []
    for r in lines:
        feats = []
        for t in r.tokens:
            if t not in cache:
                own, near = token_features(t, vocabulary)
                cache[t] = (_ids("o:", own), _ids("p:", near), _ids("q:", near), _ids("r:", near))
        file = file_features(r.n_tokens, r.n_digits)
        n = len(r.tokens)
        for i, t in enumerate(r.tokens):
            x = file + cache[t][0]
            x = x + (cache[r.tokens[i - 1]][1] if i else []) + (cache[r.tokens[i - 2]][2] if i > 1 else [])
            feats.append(x + (cache[r.tokens[i + 1]][3] if i + 1 < n else []))
        rows.append(feats)
    wide = max(len(x) for f in rows for x in f)
    ids = np.zeros((len(rows), max(map(len, rows)), wide), np.int64)
    tags = np.zeros(ids.shape[:2], np.int64)
    for i, (f, r) in enumerate(zip(rows, lines)):
        for t, x in enumerate(f):
            ids[i, t, :len(x)] = x
        tags[i, :len(r.tags)] = r.tags
    return ids, tags, np.array([len(f) for f in rows])


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def fit(lines: list, epochs: int = 12, batch: int = 64, rate: float = 0.3, decay: float = 1e-3) -> Field | None:
    """Maximum likelihood by AdaGrad on forward-backward marginals; None without a secret to learn from."""
    if not any(any(r.tags) for r in lines):
        return None
    vocabulary = known_words(lines)
    ids, tags, lengths = _padded(lines, vocabulary)
    w, moves, start = np.zeros((DIMS, 3)), np.zeros((3, 3)), np.zeros(3)
    sums = [np.full(a.shape, 1e-6) for a in (w, moves, start)]
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        order = rng.permutation(len(lengths))
        for at in range(0, len(order), batch):
            pick_ = order[at:at + batch]
            n, top = lengths[pick_], int(lengths[pick_].max())
            f, y = ids[pick_, :top], tags[pick_, :top]
            on = np.arange(top)[None] < n[:, None]
            e = w[f].sum(2)
            m, s = _masked(moves, start)
            fwd, bwd = np.zeros_like(e), np.zeros_like(e)
            fwd[:, 0] = e[:, 0] + s
            for t in range(1, top):
                step = _lse(fwd[:, t - 1, :, None] + m[None], 1) + e[:, t]
                fwd[:, t] = np.where(on[:, t, None], step, fwd[:, t - 1])
            for t in range(top - 2, -1, -1):
                step = _lse(m[None] + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
                bwd[:, t] = np.where(on[:, t + 1, None], step, 0)
            z = _lse(fwd[:, -1], 1)
            grad = np.exp(fwd + bwd - z[:, None, None])
            grad[np.arange(len(n))[:, None], np.arange(top)[None], y] -= 1
            grad *= on[..., None]
            pair = fwd[:, :-1, :, None] + m[None, None] + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]
            pair = np.exp(np.minimum(pair, 0)) * on[:, 1:, None, None]
            g_moves = pair.sum((0, 1))
            both = on[:, 1:]
            np.add.at(g_moves, (y[:, :-1][both], y[:, 1:][both]), -1)
            g_w = np.zeros_like(w)
            for k in range(3):
                g_w[:, k] = np.bincount(f.ravel(), weights=np.repeat(grad[..., k].ravel(), f.shape[2]), minlength=DIMS)
            g_w[0] = 0
            for a, g, total in ((w, g_w, sums[0]), (moves, g_moves, sums[1]), (start, grad[:, 0].sum(0), sums[2])):
                g = g / len(n) + decay * a
                total += g * g
                a -= rate * g / np.sqrt(total)
            w[0] = 0
    return Field(w.astype(np.float32), moves, start, vocabulary)


def train(docs: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> Field | None:
    return fit(training_lines(docs, max_train_docs))


def scan(docs: DataFrame, field: Field | None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every row's ``carry`` columns and ``spans``: array of (start, end, kind) by start, then kind as listed."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # size fixed by DIMS
    names = list(dict.fromkeys([*carry, "text"]))
    rows = docs.select(*[F.col(f"`{n}`") for n in names])
    kinds = dict(rows.dtypes)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value) if shared.value is not None else None
        for b in slices(batches, "text", 1_000_000):
            texts = [t or "" for t in b.column("text").to_pylist()]
            found = [base_spans(t) for t in texts]
            if tagger is not None:
                for base, more in zip(found, tagger.tag(texts)):
                    fixed = list(base)
                    base += [(s, e, "crf") for s, e in more if not any(s < y and e > x for x, y, _ in fixed)]
                    base.sort(key=lambda x: (x[0], KINDS.index(x[2])))
            spans = pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in f] for f in found], pa.list_(span))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in carry), spans], names=[*carry, "spans"])

    schema = ", ".join([*(f"`{n}` {kinds[n]}" for n in carry),
                        "spans array<struct<start: long, end: long, kind: string>>"])
    return map_batches(rows, run, schema)


def redact(text: str | None, spans: list[dict], mask: str = "[SECRET]") -> str | None:
    """The text with the union of its spans replaced, one mask for each run."""
    if not text or not spans:
        return text
    merged: list[list[int]] = []
    for s in sorted(spans, key=lambda x: x["start"]):
        if merged and s["start"] < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s["end"])
        else:
            merged.append([s["start"], s["end"]])
    out, at = [], 0
    for s, e in merged:
        out += [text[at:s], mask]
        at = e
    return "".join([*out, text[at:]])


def redact_documents(found: DataFrame) -> DataFrame:
    """Rows with ``text`` and ``spans``: the text redacted, ``spans`` dropped."""
    keep = [c for c in found.columns if c != "spans"]
    kinds = dict(found.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            texts = [redact(t, s or []) for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in keep], names=keep)
    return map_batches(found, run, ", ".join(f"`{c}` {kinds[c]}" for c in keep))


def span_text(column, kinds: tuple[str, ...] = KINDS):
    """``kind:start:end`` of an array of spans, comma-joined."""
    chosen = F.filter(column, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
