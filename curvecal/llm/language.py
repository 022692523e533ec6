"""Language identification with error-correcting output codes.

Every language has a codeword. One binary classifier per bit weighs hashed letter n-grams
(one to three letters) by the log-odds between the languages whose bit is 1 and those whose
bit is 0. The n-gram counts of each language come from all training texts in one pass; only
languages x buckets numbers reach the driver. A text's bit margins are put on a scale where
the training means lie near -1 and +1, and the codeword with the least weighted logistic
loss wins; bits that separate their two sides better weigh more. Texts whose best two
codewords are close are flagged as ambiguous.

Null texts and texts without a letter get ``und`` and score 0, and so does every text if
nothing could be learned. Texts or languages that are null are not learned from. Every whole
text counts; repeated rows count as often as they occur and get equal results.
"""

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 14
BLOCK_CHARS = 400_000
UNKNOWN = "und"

_letters = np.zeros(0, bool)


def letter_table() -> np.ndarray:
    global _letters
    if not len(_letters):
        _letters = np.fromiter((chr(i).isalpha() for i in range(1 << 16)), bool, 1 << 16)
    return _letters


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, and the text each belongs to.

    Whatever is no letter counts as one space; n-grams of spaces only are left out.
    """
    codes, owner = [], []
    for i, t in enumerate(texts):
        c = np.frombuffer(f"  {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        small = c < (1 << 16)
        letter = np.zeros(len(c), bool)
        letter[small] = letter_table()[c[small]]
        for x in np.unique(c[~small]):
            letter[c == x] = chr(x).isalpha()
        c[~letter] = 32
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # runs of spaces become one
        keep[:2] = True
        c = c[keep]
        codes.append(c)
        owner.append(np.full(len(c), i, np.int32))
    c, own = np.concatenate(codes).astype(np.uint64), np.concatenate(owner)
    out, who = [], []
    h = np.zeros(len(c), np.uint64)
    for n in (1, 2, 3):
        h = (h + c[: len(h)] if n == 1 else h[:-1] * np.uint64(0x100000001B3) + c[n - 1:]) + np.uint64(n)
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        b = (mixed >> np.uint64(64 - 14)).astype(np.int64)
        good = own[: len(h)] == own[n - 1:]
        blank = np.ones(len(h), bool)
        for k in range(n):
            blank &= c[k: len(h) + k] == 32
        good &= ~blank
        out.append(b[good])
        who.append(own[: len(h)][good])
    return np.concatenate(out), np.concatenate(who)


def blocks(texts: list[str]):
    """Indexes of texts in blocks of bounded size."""
    part, size = [], 0
    for i, t in enumerate(texts):
        part.append(i)
        size += len(t)
        if size >= BLOCK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def codewords(n: int) -> np.ndarray:
    """One row of -1 and 1 per language: all splits of up to 6, a fixed wide code of more."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        bits = [b for b in itertools.product((1, -1), repeat=n) if b[0] == 1 and -1 in b]
        return np.array(bits).T.astype(float)
    width, best, apart = 16 * int(np.ceil(np.log2(n))), None, -1
    rng = np.random.default_rng(20)
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, width))
        code = code[:, (code.min(0) < 0) & (code.max(0) > 0)]
        least = min((code[a] != code[b]).sum() for a, b in itertools.combinations(range(n), 2))
        if least > apart:
            best, apart = code, least
    return best


class Codes:
    """The fitted classifiers: weights (bucket x bit), scale and weight of bits, codewords."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.words = codewords(len(languages))
        if not languages:
            return
        smooth = counts + 0.5
        p = smooth / smooth.sum(1, keepdims=True)
        one = self.words.shape[1]
        self.weights = np.zeros((counts.shape[1], one), np.float32)
        middle, half = np.zeros(one), np.ones(one)
        for b in range(one):
            up, down = p[self.words[:, b] > 0], p[self.words[:, b] < 0]
            if not len(down):
                continue
            w = np.log(up.mean(0)) - np.log(down.mean(0))
            means = p @ w
            low, high = means[self.words[:, b] < 0].max(), means[self.words[:, b] > 0].min()
            self.weights[:, b] = w
            middle[b], half[b] = (low + high) / 2, max((high - low) / 2, 1e-3)
        self.middle, self.half = middle, half
        self.bit_weight = half / half.sum()

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        label, score, unsure = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        if not self.languages:
            return label, score, unsure
        for part in blocks([t or "" for t in texts]):
            bucket, who = grams([texts[i] or "" for i in part])
            n = np.bincount(who, minlength=len(part))
            sums = np.zeros((len(part), self.weights.shape[1]))
            if len(who):
                order = np.argsort(who, kind="stable")
                first = np.flatnonzero(np.diff(who[order], prepend=-1))
                sums[who[order][first]] = np.add.reduceat(self.weights[bucket[order]], first, axis=0, dtype=np.float64)
            z = (sums / np.maximum(n, 1)[:, None] - self.middle) / self.half
            loss = np.logaddexp(0, -2 * np.clip(z, -20, 20)[:, None, :] * self.words[None]) @ self.bit_weight
            p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
            p /= p.sum(1, keepdims=True)
            best = loss.argmin(1)
            top = np.sort(p, 1)
            for k, i in enumerate(part):
                if n[k]:
                    label[i], score[i] = self.languages[best[k]], p[k, best[k]]
                    unsure[i] = p.shape[1] > 1 and top[k, -1] - top[k, -2] < 0.2
        return label, score, unsure


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(training: DataFrame, text: str = "text", lang: str = "lang") -> Codes:
    """Learn from all rows with a text and a language."""
    def count(frames):
        sums: dict[str, np.ndarray] = {}
        for f in frames:
            for part in blocks(list(f["text"])):
                bucket, who = grams([f["text"].iloc[i] for i in part])
                names, index = np.unique(f["lang"].to_numpy(dtype=object)[part].astype(str), return_inverse=True)
                table = np.bincount(index[who] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for name, row in zip(names, table):
                    sums[name] = sums.get(name, 0) + row
        for name, row in sums.items():
            at = np.flatnonzero(row)
            yield pd.DataFrame({"lang": name, "bucket": at.astype(np.int32), "n": row[at].astype(np.int64)})

    rows = (training.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
            .where("text IS NOT NULL AND lang IS NOT NULL")
            .mapInPandas(count, "lang string, bucket int, n bigint")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
            .groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts")).collect())
    languages = sorted(r.lang for r in rows)
    counts = np.zeros((len(languages), BUCKETS))
    for r in rows:
        pairs = np.array(r.counts, dtype=np.int64)
        counts[languages.index(r.lang), pairs[:, 0]] = pairs[:, 1]
    return Codes(languages, counts)


def predict(df: DataFrame, codes: Codes, text: str = "text") -> DataFrame:
    """Add lang_pred, score and ambiguous; columns with these names are replaced."""
    new = {"lang_pred": T.StringType(), "score": T.DoubleType(), "ambiguous": T.BooleanType()}
    df = df.drop(*new)
    shared = df.sparkSession.sparkContext.broadcast(codes)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            label, score, unsure = shared.value.predict(b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(label, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())],
                names=[*b.schema.names, *new])

    return df.mapInArrow(run, T.StructType([*df.schema, *(T.StructField(k, t) for k, t in new.items())]))
