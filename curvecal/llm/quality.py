"""Quality classifier trained without labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. All documents
are counted by their pattern of votes (at most 3 to the power of the labellers, a bound that
does not depend on the data), and expectation-maximisation on the patterns estimates how
often good and bad documents exist and how each labeller votes on either. The posterior of
a document's pattern is its training label. A linear scorer over hashed word shapes (and
pairs of neighbouring shapes) learns those labels from a bounded sample of ``SAMPLE`` rows
and judges every document: a document is rejected if its score is under one half.

Null texts, empty texts and texts without a word get no votes; their score is the estimated
share of good documents, so they are kept if most documents are good. Whole texts
and whole words count: a word's shape with more than ``PIECE`` runs counts as several; repeated rows count as often as they occur and get equal scores. With an empty table
every parameter keeps its starting value.
"""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows from which the scorer is fitted, at most (chosen by a hash of the text).
SAMPLE = 8_000
BUCKETS = 1 << 11
BELIEF = 20
PIECE = 8  #: runs of a shape in the scorer; longer shapes are several
CACHED = 64  #: characters of the longest words whose shapes are remembered
GOOD, BAD, NONE = 1, -1, 0

_shapes: dict[str, str] = {}


def shape(word: str) -> str:
    """Runs of character kinds in the whole word: A upper, a lower, 0 digit, other characters as they are."""
    found = _shapes.get(word)
    if found is None:
        out = []
        for c in word:
            k = "0" if c.isdigit() else ("A" if c.isupper() else "a") if c.isalpha() else c
            if not out or out[-1] != k:
                out.append(k)
        found = "".join(out)
        if len(word) <= CACHED:
            if len(_shapes) > 300_000:
                _shapes.clear()
            _shapes[word] = found
    return found


def forget() -> None:
    """At the end of a task: the worker is reused, and what it remembers would add to what later stages need."""
    _shapes.clear()


def pieces(s: str) -> list[str]:
    """A shape of more than PIECE runs as several shapes."""
    return [s[i:i + PIECE] for i in range(0, len(s), PIECE)]


def split_counts(counts: Counter) -> tuple[Counter, int]:
    """Counts with long shapes in pieces, and how many pieces there are beyond one a shape."""
    out, more = Counter(), 0
    for key, k in counts.items():
        if isinstance(key, tuple):
            out[key[0] if len(key[0]) <= PIECE else pieces(key[0])[-1], key[1][:PIECE]] += k
        elif len(key) <= PIECE:
            out[key] += k
        else:
            parts = pieces(key)
            more += k * (len(parts) - 1)
            for x in (*parts, *zip(parts, parts[1:])):
                out[x] += k
    return out, more


def describe(text: str | None) -> tuple[list[str], Counter, int]:
    """Words, counts of their shapes and neighbouring shapes, words equal to the one before."""
    words = text.split() if text else []
    if not words:
        return words, Counter(), 0
    shapes = list(map(shape, words))
    counts = Counter(shapes)
    counts.update(Counter(zip(shapes, shapes[1:])))
    same = sum(map(str.__eq__, words, words[1:]))
    return words, counts, same


def _vote(value: float, good: float, bad: float) -> int:
    """Good at or below ``good``, bad at or above ``bad``, nothing between."""
    return GOOD if value <= good else BAD if value >= bad else NONE


LABELLERS = ["upper_case", "marked_words", "bare_marks", "plain_words", "repeats", "distinct_words", "sentence_ends", "line_repeats"]


def votes(text: str | None, known: tuple | None = None) -> list[int]:
    words, counts, same = known or describe(text)
    n = len(words)
    if n == 0:
        return [NONE] * len(LABELLERS)
    upper = marked = bare = plain = ends = size = 0
    for s, k in counts.items():
        if isinstance(s, tuple):
            continue
        ends += k * (s[-1] in ".!?")
        k *= -(-len(s) // PIECE)  # long words weigh as their pieces
        size += k
        kinds = s.strip("([{<\"'«“‘„")
        tail = s[-1]
        if kinds[:1] not in ("a", "A", "0"):
            bare += k * (kinds[-1:] not in ("a", "A", "0"))
        elif kinds == "A" or kinds[0] == "A" and "a" not in kinds and len(kinds) > 1:
            upper += k
        elif kinds.rstrip(".,;:!?)]}\"'»”’…") in ("a", "Aa", "0", "a-a", "a'a", "a’a"):
            plain += k
        if kinds[:1] in ("a", "A") and tail not in "aA0.,;:?)\"'»”’":
            marked += k
    lines = [x for x in text.split("\n") if x.strip()]
    line_share = 1 - len(set(lines)) / len(lines) if len(lines) > 1 else 0.0
    gap = n / max(1, ends)
    return [
        _vote(upper / size, 0.2, 0.5), _vote(marked / size, 0.1, 0.4), _vote(bare / size, 0.05, 0.2),
        _vote(1 - plain / size, 0.2, 0.4), _vote(same / n, 0.05, 0.25),
        _vote(1 - len(set(words)) / n, 0.6, 0.85) if n >= 30 else NONE,
        _vote(max(gap / 60, 1.2 / gap), 1.0, 1.1) if n >= 20 else NONE,
        _vote(line_share, 0.3, 0.7) if len(lines) >= 4 else NONE,
    ]


def pattern(v: list[int]) -> int:
    return sum((x + 1) * 3 ** i for i, x in enumerate(v))


def unpattern(p: int) -> list[int]:
    return [p // 3 ** i % 3 - 1 for i in range(len(LABELLERS))]


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, dict]:
    """Posterior of "good" for each vote pattern, and the estimated accuracies.

    A labeller's silence says nothing. Every labeller starts as better than chance, a belief
    that weighs as much as BELIEF documents of either class: it fixes which class is called
    good, keeps every probability inside (0, 1), and yields to the data as they grow.
    """
    m = patterns.shape[1] if len(patterns) else len(LABELLERS)
    prior = 0.8
    table = np.zeros((2, m, 2))  # class (bad, good), labeller, answer (bad, good)
    table[0], table[1] = [0.4, 0.6], [0.02, 0.98]
    belief = table * BELIEF
    post = np.zeros(len(patterns))
    spoke, index = patterns != NONE, (patterns == GOOD).astype(int)
    for _ in range(rounds if len(patterns) else 0):
        like = (np.log(table[:, np.arange(m), index]) * spoke).sum(2)
        like += np.log([1 - prior, prior])[:, None]
        post = 1 / (1 + np.exp(np.clip(like[0] - like[1], -700, 700)))
        for c, w in ((0, (1 - post) * counts), (1, post * counts)):
            for a in range(2):
                table[c, :, a] = (w[:, None] * (spoke & (index == a))).sum(0) + belief[c, :, a]
        table /= table.sum(2, keepdims=True)
        prior = (float((post * counts).sum()) + 1) / (float(counts.sum()) + 2)
    accuracy = {name: (float(table[1, i, 1]), float(table[0, i, 0])) for i, name in enumerate(LABELLERS)}
    return post, {"prior": prior, "accuracy": accuracy}


def features(counts: Counter, n: int, same: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and square roots of shares."""
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0)
    if any(len(k) > PIECE if isinstance(k, str) else len(k[0]) > PIECE or len(k[1]) > PIECE for k in counts):
        counts, more = split_counts(counts)
        n += more
    items = [*counts.items(), ("=", same), ("*", len(counts))]
    at = np.fromiter((zlib.crc32(str(k).encode("utf-8", "replace")) % BUCKETS for k, _ in items), np.int64, len(items))
    return at, np.sqrt(np.fromiter((v for _, v in items), float, len(items)) / n)


class Scorer:
    blank = 0.8  #: score of a text without a word: the estimated share of good documents

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None) -> float:
        words, counts, same = describe(text)
        if not words:
            return self.blank
        at, x = features(counts, len(words), same)
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights[at] + self.bias, -500, 500))))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 600, l2: float = 1e-5) -> Scorer:
    """Logistic regression on soft labels by accelerated gradient."""
    if not rows:
        return Scorer(np.zeros(BUCKETS), 1.0)
    at = np.concatenate([r[0] for r in rows])
    x = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    target = np.array([r[2] for r in rows])
    step = 4.0 / (float(np.bincount(row, x * x, len(rows)).max(initial=0)) + 1) / len(rows)
    w, b = np.zeros(BUCKETS), 0.0
    pw, pb = w.copy(), b
    for t in range(rounds):
        m = t / (t + 3)
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        margin = np.bincount(row, x * vw[at], len(rows)) + vb
        error = 1 / (1 + np.exp(-np.clip(margin, -500, 500))) - target
        pw, pb = w, b
        w = vw - step * (np.bincount(at, x * error[row], BUCKETS) + l2 * len(rows) * vw)
        b = vb - step * float(error.sum())
    return Scorer(w, b)


class Model:
    def __init__(self, scorer: Scorer, report: dict):
        self.scorer, self.report = scorer, report


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    """Vote patterns of all documents; scorer on at most about ``sample`` of them."""
    source = docs.select(F.col(f"`{text}`").cast("string").alias("text"))

    def count(batches):
        found: Counter = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                found[pattern(votes(t))] += 1
        forget()
        yield pa.RecordBatch.from_pydict({"pattern": pa.array(list(found), pa.int32()),
                                          "n": pa.array(list(found.values()), pa.int64())})

    seen = source.mapInArrow(count, "pattern int, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    patterns = np.array([unpattern(r.pattern) for r in seen]).reshape(len(seen), len(LABELLERS))
    post, report = expectation_maximisation(patterns, np.array([r.n for r in seen], float))
    posterior = {r.pattern: float(p) for r, p in zip(seen, post)}
    total = sum(r.n for r in seen)
    cells = 1 << 20
    share = min(cells, int(cells * sample / max(1, total)) + 1)
    cell = F.pmod(F.xxhash64("text"), F.lit(cells))
    chosen = source.where(cell < share).distinct().withColumn("cell", cell)

    def describe_rows(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            out = []
            for t in texts:
                known = describe(t)
                at, x = features(known[1], len(known[0]), known[2])
                out.append((at.tolist(), x.tolist(), pattern(votes(t, known))))
            yield pa.RecordBatch.from_pydict({
                "cell": b.column("cell"), "text": b.column("text"), "at": pa.array([o[0] for o in out], pa.list_(pa.int64())), "x": pa.array([o[1] for o in out], pa.list_(pa.float64())),
                "pattern": pa.array([o[2] for o in out], pa.int32())})
        forget()

    # a text that occurs very often comes once: its copies have one hash and would crowd out the rest
    rows = (chosen.mapInArrow(describe_rows, "cell bigint, text string, at array<bigint>, x array<double>, pattern int")
            .orderBy("cell", "text").limit(sample).select("at", "x", "pattern").toLocalIterator())
    scorer = fit_scorer([(np.array(r.at, np.int64), np.array(r.x), posterior[r.pattern]) for r in rows])
    scorer.blank = report["prior"]
    return Model(scorer, report)


def classify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add quality_score (0 to 1) and keep; columns with these names are replaced."""
    docs = docs.drop("quality_score", "keep")
    shared = docs.sparkSession.sparkContext.broadcast(model.scorer)

    def run(batches):
        for b in batches:
            s = [shared.value.score(t) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(s, pa.float64()), pa.array([v >= 0.5 for v in s], pa.bool_())],
                names=[*b.schema.names, "quality_score", "keep"])
        forget()

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField("quality_score", T.DoubleType()),
                                              T.StructField("keep", T.BooleanType())]))
