"""Personal data: strict base patterns, and a semi-Markov conditional random field that adds spans.

The field labels segments, not tokens: a candidate is a run of one to MAX_TOKENS tokens (an entity is bounded), its
features look at the whole span (its shape, digits, Luhn sum, alphabet, the word before it), a weight links each label
to the one before, and dynamic programming over segments chooses boundaries and kinds together. Tokens without a digit,
@, = or + can't begin or end a candidate (but for words that announce a secret), so only stretches near such characters
need the program; everywhere else the best path is known to be outside. These bounds are rules of the model.

Weights maximise the conditional likelihood: the forward and backward recursions over segments give the partition
function and the expected counts of features and transitions, whose difference from those of the labels is the gradient.
Training takes at most TRAIN_STRETCHES stretches of all texts: those of the lowest hashes, kind by kind, and as many
without a label. Tasks keep their lowest ones, so the sample depends on neither row order nor partitions, copies count
once, and only bounded pieces reach the driver. The labels are the base spans and, for secrets, a few strict forms; no
feature says whether a base pattern matches, so the field learns shapes; but as its labels are these patterns, it mostly
learns them back, and adds little besides secrets. Base spans always stay; the field's are added where they don't touch one.

Defined results: a null or empty text has no spans; null ids are ids like others; equal rows get equal spans; an empty
table gives no rows (the field is then untrained and adds nothing); other columns, whatever their names, are ignored.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stored

KINDS, EXTRA = ("email", "ip", "card", "phone"), ("secret",)
LABELS = KINDS + EXTRA
MAX_TOKENS, NEAR = 6, 3
TRAIN_STRETCHES, STEPS, PENALTY, MAX_PIECE, SEED = 800, 80, 0.02, 2000, 42

Span = tuple[str, int, int]  # kind, start, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# the contract's patterns with the backtracking taken out: a match starts at the first digit of a run, and runs are taken whole
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: each @ has one possible match, from the first character of the run before it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if "@" in text:
        out += [("email", s, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(n := p.lstrip("0")) <= 3 and int(n or "0") <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdecimal, m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=_order)


def _order(span: Span) -> tuple[int, int]:
    return span[1], LABELS.index(span[0])


# --- the field -------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"\S+")
_TRIGGER = re.compile(r"[0-9@=+]")
_TRIM_LEFT, _TRIM_RIGHT = "\"'([{<,;:", "\"')]}>,;:.!?"
#: Words that announce secrets and numbers.
_SECRET_WORDS = {"password", "passwd", "pwd", "token", "secret", "key", "apikey", "api_key", "auth", "bearer", "credential", "passphrase"}
_PHONE_WORDS = {"phone", "tel", "telephone", "call", "mobile", "cell", "fax"}
_SHAPE = re.compile(r"[0-9]+|[^\W\d_]+|(.)\1*", re.DOTALL)
_STRICT_SECRET = re.compile(r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16,}|(?:password|passwd|token|secret|api_key)\s?=\s?\"?[A-Za-z0-9]{12,}\"?")


def stretches(text: str) -> Iterator[list[tuple[int, int]]]:
    """Lists of the tokens (start, end) near triggers; stretches don't share tokens, and candidates don't leave them."""
    near: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        low = m.start()
        if near and low < near[-1][1]:
            continue
        start = low
        while start > 0 and not text[start - 1].isspace():
            start -= 1
        end = _TOKEN.match(text, start).end()
        near.append((start, end))
    group: list[tuple[int, int]] = []
    for start, end in near:
        if group:
            between = [(group[-1][1] + m.start(), group[-1][1] + m.end()) for m in _TOKEN.finditer(text[group[-1][1] : min(start, group[-1][1] + 200)])]
            if start - group[-1][1] < 200 and len(between) <= NEAR:
                group += between
                group.append((start, end))
                continue
            yield group
        group = [*_tokens_before(text, start), (start, end)]
    if group:
        yield group


def _tokens_before(text: str, end: int) -> list[tuple[int, int]]:
    """The token before, which may announce the next one; it is never another stretch's, as those end more than NEAR tokens before."""
    low = max(0, text.rfind("\n", 0, end) + 1, end - 40)
    return [(low + m.start(), low + m.end()) for m in _TOKEN.finditer(text[low:end])][-1:]


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in _TRIM_LEFT:
        start += 1
    while end > start and text[end - 1] in _TRIM_RIGHT:
        end -= 1
    return start, end


def _word_before(text: str, start: int) -> str:
    m = re.search(r"(\w+)\W*$", text[max(0, start - 40) : start])
    return m[1].lower() if m else ""


def span_features(text: str, start: int, end: int, n_tokens: int) -> list[str]:
    """Of the whole span text[start:end]."""
    s = text[start:end]
    digits = "".join(c for c in s if c in "0123456789")
    letters, rest = sum(map(str.isalpha, s)), re.sub(r"[A-Za-z0-9]", "", s)
    n = len(digits)
    out = ["bias", f"tokens{n_tokens}", f"digits{0 if not n else min(20, n // 2 * 2)}"]
    out.append("letters" if letters else "noletters")
    out.append("shape-" + _SHAPE.sub(lambda m: "9" if m[0][0].isdigit() else "a" if m[0][0].isalpha() else m[0][0], s)[:12])
    if (parts := s.split("."))[3:] and all(p.isdecimal() and len(p) <= 3 and int(p) <= 255 for p in parts):
        out.append(f"dotted{len(parts)}")
    if n >= 12 and luhn(digits):
        out.append("luhn")
    if not letters and set(rest) <= set(" ().+-"):
        out.append("number-" + ("plus" if s[0] == "+" else "paren" if "(" in s else "dash" if "-" in rest or " " in rest else "bare"))
    if "@" in s:
        out.append("at")
    if m := re.search(r"[A-Za-z0-9]{12,}", s):
        long = m[0]
        mixed = any(map(str.isdecimal, long)) and any(map(str.isalpha, long))
        out += ["long", "mixed" if mixed else "plain"]
        if mixed and re.fullmatch(r"[0-9a-f]+", long):
            out.append("hex")
        if mixed and long.isupper():
            out.append("upper")
    head = re.match(r"\W*(\w+)\s?[=:]", s)
    if head:
        out.append("secret-head" if head[1].lower() in _SECRET_WORDS else "head")
    if (s.count('"') + s.count("'")) % 2:
        out.append("open-quote")
    if s[-1:] in "=:":
        out.append("open-end")
    before = _word_before(text, start)
    if before in _SECRET_WORDS:
        out.append("after-secret-word")
    if before in _PHONE_WORDS:
        out.append("after-phone-word")
    return out


OUT = len(LABELS)  # the number of the label of a token outside
Candidate = tuple[int, int, int, list[str]]  # first token, start, end, features


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[list[Candidate]]:
    """For each token, those that end with it."""
    out = []
    starts = [_TRIGGER.search(text, s, e) is not None for s, e in tokens]
    begins = [t or text[s:e].lower() in _SECRET_WORDS for t, (s, e) in zip(starts, tokens)]
    for j in range(len(tokens)):
        here = []
        for i in range(j, max(-1, j - MAX_TOKENS), -1) if starts[j] else ():
            if "\n" in text[tokens[i][0] : tokens[j][1]]:
                break
            if begins[i]:
                start, end = _trim(text, tokens[i][0], tokens[j][1])
                if end - start >= 6:
                    here.append((i, start, end, span_features(text, start, end, j - i + 1)))
        out.append(here)
    return out


class SemiMarkov:
    """Weights of (feature, kind), and of a label after another: first the label before."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, links: np.ndarray | None = None) -> None:
        self.weights = weights or {}
        self.links = np.zeros((OUT + 1, OUT + 1)) if links is None else links
        self._after = self.links.tolist()
        self._known = {f: w.tolist() for f, w in self.weights.items()}

    def best(self, found: list[list[Candidate]]) -> list[tuple[str, int, int, list[str]]]:
        """Viterbi over segments."""
        low, after = float("-inf"), self._after
        score, back = [[low] * OUT + [0.0]], [[None] * (OUT + 1)]  # by the last segment's label; outside comes first
        for j, here in enumerate(found):
            before = score[j]
            prev = max(range(OUT + 1), key=lambda y: before[y] + after[y][OUT])
            now, how = [low] * OUT + [before[prev] + after[prev][OUT]], [None] * OUT + [(prev, j, None)]
            for c in here:
                before = score[c[0]]
                known = [w for f in c[3] if (w := self._known.get(f))]
                for y in range(OUT):
                    prev = max(range(OUT + 1), key=lambda z: before[z] + after[z][y])
                    s = before[prev] + after[prev][y] + sum(w[y] for w in known)
                    if s > now[y]:
                        now[y], how[y] = s, (prev, c[0], c)
            score.append(now)
            back.append(how)
        out, j = [], len(found)
        y = max(range(OUT + 1), key=lambda z: score[j][z])
        while j:
            prev, i, c = back[j][y]
            if c:
                out.append((LABELS[y], *c[1:]))
            y, j = prev, i
        return out[::-1]

    def spans(self, text: str) -> list[Span]:
        if not self.weights:
            return []
        out = []
        for tokens in stretches(text):
            found = candidates(text, tokens)
            if any(found):
                out += [s[:3] for s in self.best(found)]
        return out


def _gold(text: str, found: list[list[Candidate]]) -> list[tuple[str, int, int, list[str]]]:
    """The candidates that are base spans or strict secrets; secrets take what they overlap."""
    secret = [("secret", *_trim(text, *m.span())) for m in _STRICT_SECRET.finditer(text)]
    base = [b for b in base_spans(text) if not any(b[1] < e and s < b[2] for _, s, e in secret)]
    at = {(s, e): f for here in found for _, s, e, f in here}
    return [(k, s, e, at[s, e]) for k, s, e in [*base, *secret] if (s, e) in at]


Piece = tuple[int, str, list[int]]  # hash, text, the tokens' offsets


def pieces(text: str) -> Iterator[tuple[list[str], Piece]]:
    """The stretches that training may use, with the kinds of their labels ("none" without one)."""
    for tokens in stretches(text):
        low, high = max(0, tokens[0][0] - 40), tokens[-1][1]
        if len(tokens) <= 60 and high - low <= MAX_PIECE:
            piece = text[low:high]
            kinds = {k for k, *_ in base_spans(piece)} | ({"secret"} if _STRICT_SECRET.search(piece) else set())
            yield sorted(kinds) or ["none"], (xxhash.xxh64_intdigest(piece.encode("utf-8", "surrogatepass"), SEED) >> 1, piece, [x - low for t in tokens for x in t])


class Lowest:
    """For each kind, the TRAIN_STRETCHES distinct pieces of the lowest hashes."""

    def __init__(self) -> None:
        self.kinds: dict[str, dict[int, Piece]] = {}
        self.limits: dict[str, int] = {}

    def add(self, kinds: list[str], piece: Piece) -> None:
        for kind in kinds:
            held = self.kinds.setdefault(kind, {})
            if piece[0] < self.limits.get(kind, 1 << 63) and piece[0] not in held and any(candidates(piece[1], _tokens(piece))):
                held[piece[0]] = piece
                if len(held) >= 2 * TRAIN_STRETCHES:
                    self._cut(kind)

    def _cut(self, kind: str) -> None:
        kept = sorted(self.kinds[kind].items())[:TRAIN_STRETCHES]
        self.kinds[kind] = dict(kept)
        if len(kept) == TRAIN_STRETCHES:
            self.limits[kind] = kept[-1][0]

    def rows(self) -> Iterator[tuple[str, Piece]]:
        for kind in sorted(self.kinds):
            self._cut(kind)
            yield from ((kind, p) for p in self.kinds[kind].values())

    def sample(self) -> list[Piece]:
        """At most TRAIN_STRETCHES, in order of their hashes: the kinds take turns, and after each one without a label."""
        by_kind: dict[str, list[Piece]] = {}
        for kind, piece in self.rows():
            by_kind.setdefault(kind, []).append(piece)
        queues = {k: iter(by_kind.get(k, [])) for k in (*LABELS, "none")}
        chosen: dict[int, Piece] = {}
        while len(chosen) < TRAIN_STRETCHES and queues:
            for kind in [x for k in LABELS for x in (k, "none")]:
                if kind in queues and len(chosen) < TRAIN_STRETCHES:
                    piece = next((p for p in queues[kind] if p[0] not in chosen), None)
                    if piece:
                        chosen[piece[0]] = piece
                    else:
                        del queues[kind]
        return [chosen[k] for k in sorted(chosen)]


def _tokens(piece: Piece) -> list[tuple[int, int]]:
    return list(zip(piece[2][::2], piece[2][1::2]))


def train(texts: list[str]) -> SemiMarkov:
    lowest = Lowest()
    for text in texts:
        for kinds, piece in pieces(text or ""):
            lowest.add(kinds, piece)
    return fit(lowest.sample())


def _sums(x: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of exponentials over the next-to-last axis; -inf stands for none."""
    top = np.max(x, axis=-2, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.sum(np.exp(x - top), axis=-2)) + np.squeeze(top, -2)


class Likelihood:
    """Of the labels of a sample, for all its stretches at once. Candidates are rows of `x`; stretches are padded with nothing."""

    def __init__(self, sample: list[Piece]) -> None:
        index: dict[str, int] = {}
        rows, golds, self.lengths = [], [], []
        self.place = []  # stretch, last token, width less one
        gold_links = np.zeros((OUT + 1, OUT + 1))
        for n, piece in enumerate(sample):
            found = candidates(piece[1], _tokens(piece))
            gold = {(s, e): LABELS.index(k) for k, s, e, _ in _gold(piece[1], found)}
            taken: dict[int, tuple[int, int]] = {}  # last token of a labelled segment: first token, label
            for j, here in enumerate(found):
                for i, s, e, features in here:
                    y = gold.pop((s, e), None)  # a span that two runs of tokens give counts for the first
                    if y is not None and all(i > t for t in taken):
                        taken[j] = (i, y)
                        golds.append((len(rows), y))
                    self.place.append((n, j, j - i))
                    rows.append([index.setdefault(f, len(index)) for f in features])
            j, after = len(found), []
            while j:
                i, y = taken.get(j - 1, (j - 1, OUT))
                after.append(y)
                j = i
            for before, y in zip([OUT, *after[::-1]], after[::-1]):
                gold_links[before, y] += 1
            self.lengths.append(len(found))
        self.features = list(index)
        self.x = np.zeros((len(rows), len(index)))
        for r, columns in enumerate(rows):
            np.add.at(self.x[r], columns, 1.0)
        self.place = np.array(self.place, np.int64).reshape(-1, 3)
        self.lengths = np.array(self.lengths, np.int64)
        gold = np.zeros((len(rows), OUT))
        for r, y in golds:
            gold[r, y] = 1
        self.gold_x, self.gold_links = self.x.T @ gold, gold_links

    def gradient(self, w: np.ndarray, links: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood and its gradients by w (features, kinds) and links, by the forward and backward recursions."""
        n, longest, none = len(self.lengths), int(self.lengths.max()), -np.inf
        s = np.full((n, longest, MAX_TOKENS, OUT), none)
        scores = self.x @ w
        at = tuple(self.place.T)
        s[at] = scores
        alpha = np.full((longest + 1, n, OUT + 1), none)  # by the label of the segment that ends here
        alpha[0, :, OUT] = 0.0
        entry = np.empty((longest + 1, n, OUT + 1))  # of a segment of that label that starts here
        for j in range(longest):
            entry[j] = _sums(alpha[j][:, :, None] + links)
            ways = [entry[j - d][:, :OUT] + s[:, j, d] for d in range(min(MAX_TOKENS, j + 1))]
            alpha[j + 1, :, :OUT] = _sums(np.stack(ways, 1))
            alpha[j + 1, :, OUT] = entry[j][:, OUT]
        ends = alpha[self.lengths, np.arange(n)]
        z = _sums(ends[:, :, None])[:, 0]
        beta = np.full((longest + 1, n, OUT + 1), none)
        begin = np.full((longest, n, OUT + 1), none)  # what follows from a segment of that label that starts here
        expected = np.zeros((OUT + 1, OUT + 1))
        for j in range(longest, -1, -1):
            last = self.lengths == j
            if j < longest:
                begin[j, :, OUT] = beta[j + 1, :, OUT]
                ways = [s[:, j + d, d] + beta[j + d + 1, :, :OUT] for d in range(min(MAX_TOKENS, longest - j))]
                begin[j, :, :OUT] = _sums(np.stack(ways, 1))
                beta[j] = _sums(np.swapaxes(links + begin[j][:, None, :], 1, 2))
                p = alpha[j][:, :, None] + links + begin[j][:, None, :] - z[:, None, None]
                expected += np.exp(p[self.lengths > j]).sum(0)
            beta[j][last] = 0.0
        stretch, end, less = at
        p = np.exp(entry[end - less, stretch][:, :OUT] + scores + beta[end + 1, stretch][:, :OUT] - z[stretch][:, None])
        value = float((self.gold_x * w).sum() + (self.gold_links * links).sum() - z.sum())
        return value, self.gold_x - self.x.T @ p, self.gold_links - expected


def fit(sample: list[Piece]) -> SemiMarkov:
    """Maximum likelihood with a penalty on squares, by STEPS steps of all stretches with moments (Adam)."""
    if not sample:
        return SemiMarkov()
    data = Likelihood(sample)
    point = [np.zeros((len(data.features), OUT)), np.zeros((OUT + 1, OUT + 1))]
    mean, square = [np.zeros_like(v) for v in point], [np.zeros_like(v) for v in point]
    for step in range(1, STEPS + 1):
        _, *gradients = data.gradient(*point)
        for k, (v, g) in enumerate(zip(point, gradients)):
            g = g - PENALTY * v
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            rate = 0.3 * (1 - step / (STEPS + 1))
            point[k] = v + rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    return SemiMarkov(dict(zip(data.features, point[0])), point[1])


def all_spans(text: str | None, model: SemiMarkov) -> tuple[list[Span], list[Span]]:
    """(base, base and added)."""
    text = text or ""
    base = base_spans(text)
    added, k = [], 0
    merged: list[list[int]] = []  # base spans as disjoint stretches
    for _, start, end in base:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for span in model.spans(text):
        while k < len(merged) and merged[k][1] <= span[1]:
            k += 1
        if k == len(merged) or merged[k][0] >= span[2]:
            added.append(span)
    return base, sorted([*base, *added], key=_order)


def fitted(docs: DataFrame) -> SemiMarkov:
    """Trained on a sample of all texts. The driver gets TRAIN_STRETCHES pieces a kind at most."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lowest = Lowest()
        for b in batches:
            for t in b.column("text"):
                for kinds, piece in pieces(t.as_py()):
                    lowest.add(kinds, piece)
        rows = list(lowest.rows())
        columns = ([k for k, _ in rows], *[[p[x] for _, p in rows] for x in range(3)])
        types = (pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["kind", "hash", "piece", "tokens"])

    texts = docs.select(F.col("text").cast("string").alias("text")).where(F.rlike("text", F.lit("[0-9@=+]")))
    found = texts.mapInArrow(run, "kind string, hash long, piece string, tokens array<int>").groupBy("kind", "hash").agg(F.first("piece").alias("piece"), F.first("tokens").alias("tokens"))
    # each task has its own lowest ones: counts by ranges of hashes leave about as many as are wanted before any are ranked
    found = stored(found.withColumn("range", F.shiftright("hash", 48)), "stretches")
    before = F.sum("count").over(Window.partitionBy("kind").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    low = found.groupBy("kind", "range").count().withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < TRAIN_STRETCHES)
    few = found.join(low.select("kind", "range"), ["kind", "range"], "left_semi")
    ranked = few.withColumn("nth", F.row_number().over(Window.partitionBy("kind").orderBy("hash"))).where(F.col("nth") <= TRAIN_STRETCHES)
    lowest = Lowest()
    for r in ranked.collect():
        lowest.add([r.kind], (r.hash, r.piece, list(r.tokens)))
    return fit(lowest.sample())


def personal_data(docs: DataFrame, model: SemiMarkov | None = None) -> DataFrame:
    """doc_id, base and spans (arrays of (kind, start, end))."""
    ship(docs.sparkSession)
    model = model or fitted(docs)
    kind = "array<struct<kind:string,start:int,end:int>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    as_rows = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [all_spans(t.as_py(), model) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([as_rows(x) for x, _ in found], arrow), pa.array([as_rows(y) for _, y in found], arrow)], names=["doc_id", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")


def personal_data_report(docs: DataFrame) -> DataFrame:
    line = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    more = [F.size(F.filter("spans", lambda x: x["kind"] == "secret")).cast("long").alias("n_secret"), F.size("spans").cast("long").alias("n_spans")]
    return personal_data(docs).select("doc_id", *[count(k) for k in KINDS], F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"), *more)


def redacted(docs: DataFrame, model: SemiMarkov | None = None) -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    ship(docs.sparkSession)
    model = model or fitted(docs)

    @F.pandas_udf("string")
    def cover(texts):
        return texts.map(lambda t: None if t is None else _redact(t, all_spans(t, model)[1]))

    return docs.select(*[cover("text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def _redact(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
