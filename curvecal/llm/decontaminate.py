"""Benchmark decontamination: every training passage queries an index of the test items.

The index is a BM25 inverted index of the items, with impacts divided by the score that an
item gets for its own words, so that one threshold means the same share of every item. The
postings of a word lie in blocks of item numbers with the block's largest impact (block-max
WAND): items whose bound cannot reach the threshold are skipped block-wise. All items at or
above the threshold are retrieved, never a top few, then verified: word n-grams of the
question (all sentences but the last) and of the answer (the last) must occur in the passage.

Before that a vectorised bound drops passages that no item can owe the threshold to: the
postings of an item's frequent words are not essential (they cannot reach half the threshold),
and the essential ones are added up for all passages of a document at once.

Passages are windows of twice the longest item's words with half a window's step, so any
copy of an item lies whole in one of them. The index is broadcast and holds only the test
items; a limit on their size is checked. Documents are never shuffled.

Null and empty texts and items have no words and match nothing. Items without words are
left out. Repeated documents give repeated rows; repeated items are separate items.
"""

import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

K1, B = 1.2, 0.75
BLOCK = 32
MOST_CHARS = 50_000_000
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer; one sentence alone is all question."""
    parts = [w for w in (words(s) for s in SENTENCE.split(text)) if w]
    if len(parts) < 2:
        return (parts[0] if parts else []), []
    return [w for p in parts[:-1] for w in p], parts[-1]


def grams(tokens: list[str], n: int) -> set[tuple[str, ...]]:
    n = min(n, len(tokens))
    return {tuple(tokens[i:i + n]) for i in range(len(tokens) - n + 1)} if n else set()


class ItemIndex:
    """Inverted index of the items: for each word sorted postings in blocks."""

    def __init__(self, items: list[tuple[int, str]]):
        kept = [(i, t) for i, t in items if words(t)]
        self.ids = [i for i, _ in kept]
        self.texts = [split_item(t) for _, t in kept]
        bags = [Counter(words(t)) for _, t in kept]
        lengths = [sum(b.values()) for b in bags]
        self.longest = max(lengths, default=1)
        mean = sum(lengths) / max(1, len(lengths))
        frequency = Counter(w for b in bags for w in b)
        idf = {w: math.log(1 + (len(bags) - n + 0.5) / (n + 0.5)) for w, n in frequency.items()}
        self.words = {w: k for k, w in enumerate(frequency)}
        lists: list[list[tuple[int, float]]] = [[] for _ in self.words]
        for d, bag in enumerate(bags):
            impact = {w: idf[w] * n * (K1 + 1) / (n + K1 * (1 - B + B * lengths[d] / mean)) for w, n in bag.items()}
            own = sum(impact.values())
            for w, v in impact.items():
                lists[self.words[w]].append((d, v / own))
        self.docs = [np.array([d for d, _ in p], np.int32) for p in lists]
        self.impacts = [np.array([v for _, v in p]) for p in lists]
        self.lists = [p.tolist() for p in self.docs]
        self.last = [p[BLOCK - 1::BLOCK] if len(p) % BLOCK == 0 else [*p[BLOCK - 1::BLOCK], p[-1]] for p in self.lists]
        self.block_max = [np.maximum.reduceat(v, np.arange(0, len(v), BLOCK)).tolist() for v in self.impacts]
        self.bounds = [float(v.max()) for v in self.impacts]

    def essential(self, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Postings without which an item stays under the threshold: (first posting of each word, items, shares).

        Of each item the most frequent words with up to half the threshold's mass are left
        out. What the rest must reach is one share; a passage that gives no item a whole
        share cannot give any item the threshold.
        """
        listed: list[list[tuple[int, float]]] = [[] for _ in self.words]
        by_item: list[list[tuple[int, int, float]]] = [[] for _ in self.ids]
        for w, (docs, impacts) in enumerate(zip(self.docs, self.impacts)):
            for d, v in zip(docs.tolist(), impacts.tolist()):
                by_item[d].append((len(docs), w, v))
        for d, terms in enumerate(by_item):
            spent = 0.0
            terms.sort(reverse=True)
            while terms and spent + terms[0][2] <= threshold / 2:
                spent += terms.pop(0)[2]
            for _, w, v in terms:
                listed[w].append((d, v / (threshold - spent)))
        first = np.cumsum([0, *map(len, listed)])
        return (first, np.array([d for p in listed for d, _ in p], np.int64), np.array([v for p in listed for _, v in p]))

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items that score ``threshold`` or more for a set of words: block-max WAND."""
        end, bound = len(self.ids), self.bounds
        at = {t: 0 for t in terms}
        found = []
        order = [t for t in terms if len(self.docs[t])]

        current = {t: self.lists[t][0] for t in order}
        while order:
            order.sort(key=current.__getitem__)
            total, pivot = 0.0, -1
            for k, t in enumerate(order):
                total += bound[t]
                if total >= threshold - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                break
            doc = current[order[pivot]]
            while pivot + 1 < len(order) and current[order[pivot + 1]] == doc:
                pivot += 1
            near, beyond = 0.0, end
            for t in order[:pivot + 1]:  # shallow: only block bounds are looked at
                b = bisect_left(self.last[t], doc)
                if b < len(self.last[t]):
                    near += self.block_max[t][b]
                    beyond = min(beyond, self.last[t][b] + 1)
            if near >= threshold - 1e-9:
                if current[order[0]] == doc:
                    score = sum(float(self.impacts[t][at[t]]) for t in order[:pivot + 1])
                    if score >= threshold - 1e-9:
                        found.append((doc, score))
                    target = doc + 1
                else:
                    target = doc
            else:
                if pivot + 1 < len(order):
                    beyond = min(beyond, current[order[pivot + 1]])
                target = max(beyond, doc + 1)
            for t in order[:pivot + 1]:
                if current[t] < target:
                    its = self.lists[t]
                    at[t] = bisect_left(its, target, at[t])
                    current[t] = its[at[t]] if at[t] < len(its) else end
            order = [t for t in order if current[t] < end]
        return found


class Matcher:
    def __init__(self, items, threshold, question_share, answer_share, n):
        self.index = ItemIndex(items)
        self.threshold, self.shares, self.n = threshold, (question_share, answer_share), n
        self.size = 2 * self.index.longest
        self.essential = self.index.essential(threshold)
        self.grams = [(grams(q, n), grams(a, n)) for q, a in self.index.texts]
        self.lengths = [(min(n, len(q)), min(n, len(a))) for q, a in self.index.texts]

    def hopeful(self, known: np.ndarray, half: int) -> np.ndarray:
        """Numbers of the passages that can give some item the threshold."""
        first, items, shares = self.essential
        at = np.flatnonzero(known >= 0)
        words_, part = known[at].astype(np.int64), at // half
        pairs = np.unique(part * len(self.index.words) + words_)
        part, words_ = pairs // len(self.index.words), pairs % len(self.index.words)
        n = first[words_ + 1] - first[words_]
        posting = np.repeat(first[words_] - np.cumsum(n) + n, n) + np.arange(n.sum())
        part = np.repeat(part, n)
        last = max(0, (len(known) - 1) // half - 1)  # a passage has two parts; a short text has one passage
        passage = np.concatenate([np.minimum(part, last), np.clip(part - 1, 0, last)])
        twice = np.concatenate([posting, posting])
        same = passage[: len(part)] == passage[len(part):]  # not counted twice for one passage
        keep = np.concatenate([np.ones(len(part), bool), ~same])
        cell, inverse = np.unique(passage[keep] * len(self.index.ids) + items[twice[keep]], return_inverse=True)
        reached = np.bincount(inverse, shares[twice[keep]], len(cell)) >= 1 - 1e-9
        return np.unique(cell[reached] // len(self.index.ids))

    def document(self, text: str | None) -> list[tuple]:
        """Best verified passage of every item: (item, score, question, answer, first word)."""
        index = self.index
        if not index.ids or not text:
            return []
        tokens = words(text)
        known = np.fromiter(map(index.words.get, tokens, repeat(-1)), np.int32, len(tokens))
        half = self.size // 2
        best: dict[int, tuple] = {}
        for k in self.hopeful(known, half).tolist():
            a, b = k * half, min((k + 2) * half, len(tokens))
            terms = np.unique(known[a:b])
            terms = terms[terms >= 0]
            for d, score in index.search(terms.tolist(), self.threshold):
                passage = tokens[a:b]
                shares = []
                for want, size in zip(self.grams[d], self.lengths[d]):
                    have = {tuple(passage[i:i + size]) for i in range(len(passage) - size + 1)} if size else set()
                    shares.append(len(want & have) / len(want) if want else 1.0)
                row = (score, shares[0], shares[1], a)
                if shares[0] >= self.shares[0] and shares[1] >= self.shares[1] and (
                        d not in best or row[:3] > best[d][:3]):
                    best[d] = row
        return [(index.ids[d], *row) for d, row in sorted(best.items())]


HIT = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("question_overlap", T.DoubleType()),
    T.StructField("answer_overlap", T.DoubleType()), T.StructField("first_word", T.IntegerType())]))


def with_hits(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
              threshold: float = 0.5, question_share: float = 0.7, answer_share: float = 0.5, n: int = 4,
              out: str = "hits") -> DataFrame:
    """Add to every row the items it contains, each with its best passage; ``out`` is replaced.

    Raises if the items have more than ``MOST_CHARS`` characters (the index would not fit a worker).
    """
    chars = items.agg(F.sum(F.char_length(item_text))).first()[0] or 0
    if chars > MOST_CHARS:
        raise ValueError("too many test items for one index; give them in parts")
    rows = [(r[0], r[1]) for r in items.select(F.col(item_id).cast("bigint"), item_text).where(F.col(item_text).isNotNull()).collect()]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast((rows, threshold, question_share, answer_share, n))
    names = [f.name for f in HIT.elementType]

    def run(batches):
        matcher = Matcher(*shared.value)
        for b in batches:
            hits = [[dict(zip(names, hit)) for hit in matcher.document(t)] for t in b.column(text).to_pylist()]
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()),
                                       ("answer_overlap", pa.float64()), ("first_word", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hits, kind)], names=[*b.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(out, HIT)]))


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row for each document and item that it contains."""
    hits = with_hits(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), items, **options)
    return hits.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
