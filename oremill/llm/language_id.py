"""Language of words and texts by a linear-chain conditional random field.

A word's features are its whole form, prefixes, suffixes and all its byte n-grams,
however long it is (a sentence without blanks is one word), hashed to ``FEATURES`` weights per label, and whether it is among a label's
most frequent words (lexicon). Chains are whole lines; transitions between
labels are learned too, from lines and from pairs of half lines of different
labels, so that code-switched lines are labelled word by word. Forward-backward
gives each word's label probabilities; a text's label is that of the largest
mean over its words with a letter. Every label of the rows that may be learned
from is learned, however rare.

Learned on the driver from a bounded sample: lines, a long one in consecutive
pieces of at most ``PIECE_CHARS`` characters, of about ``DOCS`` documents of each
label, by a hash of their ids, and of these about ``LINES``, and ``LEAST`` of each
label at least, in an order of hashes that gives each label about as many.

Defined results: a null text or one without a letter is ``und`` with score 0;
so is every text when there is nothing to learn from; rows with a null lang or
doc_id are predicted, not learned from; equal texts get equal results, of two
labels with equal means the first by name is given; a very long text is worked
on alone and whole; an empty table gives an empty one; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import Words, column, slices, text_bytes
from .tables import held_out
from .word_features import PIECE, affixes_and_ngrams

FEATURES, LEXICON = 1 << 15, 500
DOCS, LINES, LEAST, PIECE_CHARS, STEPS = 1500, 6000, 20, 1000, 30
#: Labels up to which their counts are broadcast; words of a chain that are gone through at once.
MANY, BLOCK = 1000, 256
#: Bytes of text whose distinct words are looked up at once.
TOGETHER = 4 << 20

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (FEATURES, labels)
    lexicon: list[np.ndarray]  # sorted word hashes of each label
    lexical: np.ndarray  # (lexicons, labels)
    bias: np.ndarray
    transitions: np.ndarray


class Vocabulary:
    """The distinct words of a slice with their features."""

    def __init__(self, w: Words, lexicon: list[np.ndarray]):
        hashes, where, self.of = np.unique(w.hash, return_index=True, return_inverse=True)
        word, feature = affixes_and_ngrams(w, where)
        order = np.argsort(word, kind="stable")
        self.word, self.feature = word[order].astype(np.int32), ((feature[order] >> np.uint64(17)) % np.uint64(FEATURES)).astype(np.int32)
        self.begin = np.searchsorted(self.word, np.arange(len(hashes)))
        self.known = np.stack([lex[np.minimum(np.searchsorted(lex, hashes), len(lex) - 1)] == hashes if len(lex) else np.zeros(len(hashes), bool) for lex in lexicon], axis=1).astype(float)
        seen = np.concatenate([[0], np.cumsum(LETTER[w.data])])
        self.lettered = seen[(w.start + w.length)[where]] > seen[w.start[where]]

    def scores(self, m: Model) -> np.ndarray:
        s = np.zeros((len(self.begin), len(m.labels)))
        for lo in range(0, len(self.feature), PIECE):
            # a word on the border of two pieces takes its sum from both
            word = self.word[lo : lo + PIECE]
            begin = np.flatnonzero(np.diff(word, prepend=-1))
            s[word[begin]] += np.add.reduceat(m.weights[self.feature[lo : lo + PIECE]], begin, axis=0)
        return s + self.known @ m.lexical + m.bias


def chains(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of each chain: the words between line ends."""
    if not len(w):
        return np.zeros(0, int), np.zeros(0, int)
    lines = np.cumsum(w.data == 10)[w.start]
    new = np.ones(len(w), bool)
    new[1:] = (lines[1:] != lines[:-1]) | (w.row[1:] != w.row[:-1])
    begin = np.flatnonzero(new)
    return begin, np.diff(np.append(begin, len(w)))


def transfers(p: np.ndarray, a: np.ndarray, first: np.ndarray, size: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each block of words the product of what its words do to a forward vector, scaled; chains start in ``starts``."""
    out = np.tile(np.eye(p.shape[1]), (len(first), 1, 1))
    for t in range(int(size.max(initial=0))):
        k = np.flatnonzero(size > t)
        m = out[k] @ a if t else np.where(starts[k, None, None], out[k], out[k] @ a)
        m = m * p[first[k] + t][:, None, :]
        out[k] = m / m.max(axis=(1, 2), keepdims=True)
    return out


def borders(p: np.ndarray, a: np.ndarray, first: np.ndarray, size: np.ndarray, chain: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward vector before and backward vector after each block; the blocks' transfers are combined along each chain."""
    ahead, behind = np.ones((len(first), p.shape[1])), np.ones((len(first), p.shape[1]))
    many = np.bincount(chain)[chain]
    k = np.flatnonzero(many > 1)
    if not len(k):
        return ahead, behind
    t = np.zeros((len(first), p.shape[1], p.shape[1]))
    t[k] = transfers(p, a, first[k], size[k], number[k] == 0)
    for step in range(1, int(number.max()) + 1):
        k = np.flatnonzero(number == step)
        v = np.einsum("ki,kij->kj", ahead[k - 1], t[k - 1])
        ahead[k] = v / v.sum(axis=1, keepdims=True)
        k = np.flatnonzero((many - 1 - number == step))
        v = np.einsum("kij,kj->ki", t[k + 1], behind[k + 1])
        behind[k] = v / v.sum(axis=1, keepdims=True)
    return ahead, behind


def marginals(scores: np.ndarray, first: np.ndarray, size: np.ndarray, transitions: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of each word, and expected counts of transitions, of all chains at once.

    Long chains are gone through in blocks at the same time: what a block does
    to any vector is a matrix, and these give the vectors at its borders.
    """
    n, labels = scores.shape
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    a = np.exp(transitions)
    parts = -(-size // block)
    chain = np.repeat(np.arange(len(first)), parts)
    number = np.arange(len(chain)) - np.repeat(np.cumsum(parts) - parts, parts)
    stop = np.repeat(first + size, parts)
    first = np.repeat(first, parts) + number * block
    size = np.minimum(stop - first, block)
    ahead, behind = borders(p, a, first, size, chain, number)
    order = np.argsort(-size, kind="stable")
    first, size, ahead, behind, inner = first[order], size[order], ahead[order], behind[order], number[order] > 0
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
    alpha, beta = np.empty((n, labels)), np.ones((n, labels))
    beta[first + size - 1] = behind
    for t in range(longest):
        at = first[: active[t]] + t
        x = (alpha[at - 1] @ a) * p[at] if t else np.where(inner[:, None], ahead @ a, 1.0) * p[at]
        alpha[at] = x / x.sum(axis=1, keepdims=True)
    moved = np.zeros((labels, labels))
    for t in range(longest - 2, -1, -1):
        at = first[: active[t + 1]] + t
        y = p[at + 1] * beta[at + 1]
        x = y @ a.T
        total = (alpha[at] * x).sum(axis=1, keepdims=True)
        moved += (alpha[at] / total).T @ y * a
        beta[at] = x / x.sum(axis=1, keepdims=True)
    at = first[inner]
    y = p[at] * beta[at]
    moved += (ahead[inner] / (ahead[inner] * (y @ a.T)).sum(axis=1, keepdims=True)).T @ y * a
    gamma = alpha * beta
    return gamma / gamma.sum(axis=1, keepdims=True), moved


def train(lines: list[tuple[str, str]]) -> Model | None:
    """From (line, label): gradient ascent on the likelihood with per-weight step sizes."""
    labels = sorted({label for _, label in lines})
    if not labels:
        return None
    index, rng = {x: i for i, x in enumerate(labels)}, np.random.default_rng(5)
    texts, tags = [], []
    for i in rng.permutation(len(lines)):
        text, label = lines[i]
        texts.append(text)
        tags.append((len(text), index[label], index[label]))
        other, j = lines[rng.integers(len(lines))]
        if index[j] != index[label]:
            words, more = text.split(" "), other.split(" ")
            head = " ".join(words[: max(1, len(words) // 2)])
            texts.append(head + " " + " ".join(more[len(more) // 2 :]))
            tags.append((len(head.encode()), index[label], index[j]))
    data, off = text_bytes(pa.array(texts))
    w = Words(data, off, lower=True)
    if not len(w):
        return None
    switch, before, after = (np.array(x) for x in zip(*tags, strict=True))
    gold = np.where(w.start - off[w.row] < switch[w.row], before[w.row], after[w.row])
    n = len(labels)
    lexicon = []
    for label in range(n):
        h, c = np.unique(w.hash[gold == label], return_counts=True)
        lexicon.append(np.sort(h[np.lexsort((h, -c))[:LEXICON]]))
    v = Vocabulary(w, lexicon)
    first, size = chains(w)
    m = Model(labels, np.zeros((FEATURES, n)), lexicon, np.zeros((n, n)), np.zeros(n), np.zeros((n, n)))
    inner = np.ones(len(w), bool)
    inner[first] = False
    seen = np.zeros((n, n))
    np.add.at(seen, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
    steps = {k: np.full(getattr(m, k).shape, 1e-3) for k in ("weights", "lexical", "bias", "transitions")}
    rare = 1.0 / len(w)
    for _ in range(STEPS):
        gamma, moved = marginals(v.scores(m)[v.of], first, size, m.transitions)
        gap = -gamma
        gap[np.arange(len(w)), gold] += 1
        of_word = np.stack([np.bincount(v.of, gap[:, k], len(v.begin)) for k in range(n)], axis=1)
        grads = {"weights": np.stack([np.bincount(v.feature, of_word[v.word, k], FEATURES) for k in range(n)], axis=1), "lexical": v.known.T @ of_word, "bias": of_word.sum(axis=0), "transitions": seen - moved}
        for k, g in grads.items():
            g = g * rare - 1e-6 * getattr(m, k)
            steps[k] += g * g
            getattr(m, k)[...] += 0.3 * g / np.sqrt(steps[k])
    return m


def learn(docs: DataFrame) -> Model | None:
    """Trains on rows of ``docs`` (doc_id, text, lang) that may be learned from."""
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = own.groupBy("lang").agg(F.count("*").alias("__often"))
    number = counts.count()
    if not number:
        return None
    # one row a label is joined; many are left to Spark
    drawn = own.join(F.broadcast(counts) if number <= MANY else counts, "lang")
    drawn = drawn.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) * F.col("__often") < DOCS * float(1 << 30))
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("line") / PIECE_CHARS) - 1, F.lit(0)))
    pieces = F.transform(starts, lambda i: F.substring(F.col("line"), (i * PIECE_CHARS + 1).cast("int"), F.lit(PIECE_CHARS)))
    lines = drawn.select("doc_id", "lang", "__often", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.explode(pieces)).where("line != ''")
    lines = lines.withColumn("o", F.pmod(F.xxhash64("doc_id", "line"), F.lit(1 << 40)) * F.col("__often")).select("o", "line", "doc_id", "lang")
    got = {tuple(r) for r in lines.orderBy("o", "line", "doc_id", "lang").limit(max(LINES, LEAST * number)).collect()}
    # a label of which the order brought nothing has its first line
    got |= {tuple(r[0]) for r in lines.groupBy("lang").agg(F.min(F.struct("o", "line", "doc_id", "lang"))).drop("lang").collect()}
    return train([(line, lang) for _, line, _, lang in sorted(got)])


OUT = "doc_id long, lang_pred string, score double, spans array<struct<start:int,len:int,lang:string>>"


def label(docs: DataFrame, model: Model | None) -> DataFrame:
    """``OUT``: the label of each text, and runs of words (numbered from 0) of one label."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for rows, data, off in slices(batch, limit=TOGETHER):
                k = rows.num_rows
                w = Words(data, off, lower=True)
                names = np.array([*(m.labels if m else []), "und"], dtype=object)
                best, score = np.full(k, len(names) - 1), np.zeros(k)
                tag, begin = np.zeros(0, int), np.zeros(0, int)
                if m and len(w):
                    v = Vocabulary(w, m.lexicon)
                    first, size = chains(w)
                    gamma, _ = marginals(v.scores(m)[v.of], first, size, m.transitions)
                    heard = v.lettered[v.of]
                    total = np.stack([np.bincount(w.row, gamma[:, j] * heard, k) for j in range(len(m.labels))], axis=1)
                    count = np.bincount(w.row, heard, k)
                    ok = column(rows, "lettered").to_numpy(zero_copy_only=False) & (count > 0)
                    best = np.where(ok, total.argmax(axis=1), best)
                    score = np.where(ok, np.clip(total.max(axis=1) / np.maximum(count, 1), 0, 1), 0.0)
                    tag = gamma.argmax(axis=1)
                    new = np.ones(len(w), bool)
                    new[1:] = (tag[1:] != tag[:-1]) | (w.row[1:] != w.row[:-1])
                    begin = np.flatnonzero(new)
                row = w.row[begin]
                length = np.diff(np.append(begin, len(w))) if len(begin) else begin
                parts = pa.StructArray.from_arrays([pa.array((begin - w.first[row]).astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(names[tag[begin]] if len(begin) else [], pa.string())], ["start", "len", "lang"])
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(k + 1)).astype(np.int32)), parts)
                yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), pa.array(names[best], pa.string()), pa.array(score), spans], ["doc_id", "lang_pred", "score", "spans"])

    return asked.mapInArrow(work, OUT)
