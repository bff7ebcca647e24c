"""SentencePiece encoding and decoding by a max-plus scan over the lattice of pieces.

The vocabulary's segmentation by merges has a local form: a sequence of pieces
is a text's encoding just when each neighbouring pair is what the merges make
of the two pieces' joined text. In the max-plus semiring an allowed pair weighs
0 and another minus infinity, the best path has weight 0, and each prefix of a
text has one such path. So:

* A giant text (over ``CHUNK`` characters) is split into chunks wherever that
  falls. The state at a boundary is the piece that ends at it or straddles it.
  A chunk yields a matrix of weights from entry to exit states. Matrices of
  neighbours are multiplied pair by pair, in rounds that halve their number, so
  a text of n chunks has a tree of log n levels; then states come down the
  tree: what enters and leaves a product gives the state between its two
  factors. Each chunk is traced back on its own, in its own task.
* No piece has a space mark after another character, so between words the
  state is a single one and the matrix of a word is 1 x 1: words are encoded
  once for all their places in a batch. A walk down a tree of the pieces finds
  the lattice's edges at all bytes of the batch's words at once; then all words
  look for their paths together, an edge of each at a time.

``decode`` joins the pieces' bytes. Nothing is trained; the vocabulary file's
path is a parameter, read on the driver only and sent to tasks (some 32,000
pieces).

Defined results: a null text gives null ids, an empty one no ids; the character
U+2581 counts as a space, as it does in the format, so it decodes as one; other
texts decode to themselves; equal rows stay separate; an empty table gives an
empty one; other columns are passed through, but ``encode`` replaces ``ids`` and
``n_tokens`` and ``decode`` replaces ``decoded``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .batches import FINE, column, slices, text_bytes
from .tables import cut, drop, fanout

MARK = "▁"
CHUNK, KEPT = 1 << 16, 300_000
#: Bytes of text whose distinct words are encoded together.
TOGETHER = 2 << 20
#: Bytes of words that are searched together, and how few of them are no longer; bits of the places for pairs met lately.
SEARCHED, FEW, MET = 1 << 19, 16, 20


class Tree:
    """Prefix tree of the pieces' bytes, a space for the mark; it finds the edges of the lattice for many words at once."""

    def __init__(self, ids: dict[str, int], names: int):
        #: of each piece: the longest other piece that it begins with (-1: none), its bytes, whether its first character is a piece (last: of no piece)
        self.shorter, self.size, self.single = np.full(names, -1, np.int32), np.zeros(names, np.int64), np.zeros(names + 1, bool)
        # node 0 is that of no piece, node 1 the root
        down: list[dict[int, int]] = [{}, {}]
        piece = [-1, -1]
        for text, i in sorted(ids.items()):  # a piece comes after those that it begins with
            raw, at = text.replace(MARK, " ").encode(), 1
            for b in raw:
                if piece[at] >= 0:
                    self.shorter[i] = piece[at]
                if b not in down[at]:
                    down[at][b] = len(down)
                    down.append({})
                    piece.append(-1)
                at = down[at][b]
            piece[at], self.size[i], self.single[i] = i, len(raw), text[0] in ids
        self.piece = np.array(piece, np.int32)
        # only nodes that go on have a row; row 0 is that of the others
        inner = [k for k, x in enumerate(down) if x]
        self.row = np.zeros(len(down), np.int32)
        self.row[inner] = np.arange(1, len(inner) + 1)
        self.next = np.zeros((len(inner) + 1, 256), np.int32)
        for r, k in enumerate(inner, 1):
            self.next[r, list(down[k])] = list(down[k].values())

    def longest(self, data: np.ndarray) -> np.ndarray:
        """The longest piece that starts at each byte (-1: none); byte 255 is in no piece."""
        out = np.full(len(data), -1, np.int32)
        at, row, k = np.arange(len(data)), np.full(len(data), self.row[1]), 0
        while len(at):
            node = self.next[row, data[at + k]]
            found = self.piece[node]
            some = found >= 0
            out[at[some]] = found[some]
            row = self.row[node]
            on = (row > 0) & (at + k + 1 < len(data))
            at, row, k = at[on], row[on], k + 1
        return out


@dataclass
class Vocabulary:
    """Pieces that text can match, with their ranks; ids of single bytes; bytes of every id."""

    score: dict[str, float]
    ids: dict[str, int]
    byte_ids: list[int]
    bytes_of: list[bytes]
    longest: int
    alone: np.ndarray  # ASCII characters that are in no longer piece
    pairs: dict[int, bool] = field(default_factory=dict)
    words: dict[bytes, list[int]] = field(default_factory=dict)
    courses: dict[str, tuple | None] = field(default_factory=dict)
    tree: Tree | None = None
    names: dict[int, str] = field(default_factory=dict)
    met: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"pairs": {}, "words": {}, "courses": {}, "tree": None, "names": {}, "met": None}

    def course(self, piece: str) -> tuple[list[float], list[str], list[str]] | None:
        """How merges build a piece: scores in order, and its last and first part before each and at the end.

        Best score first, leftmost of equals. None: merges end elsewhere, so
        the piece never occurs.
        """
        if piece in self.courses:
            return self.courses[piece]
        parts, score, done, last, first = list(piece), self.score, [], [piece[-1]], [piece[0]]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            done.append(best)
            last.append(parts[-1])
            first.append(parts[0])
        got = (done, last, first) if len(parts) == 1 else None
        if len(self.courses) < KEPT:
            self.courses[piece] = got
        return got

    def allowed(self, a: str, b: str) -> bool:
        """Whether b may follow a: weight 0, else minus infinity.

        Both are built side by side, the better merge first; a merge across
        them that comes before one of theirs, or after all, rules them out.
        """
        if not a:
            return True
        x, y = self.course(a), self.course(b)
        if x is None or y is None:
            return False
        (sx, last, _), (sy, _, first) = x, y
        i, j, score = 0, 0, self.score
        while True:
            across = score.get(last[i] + first[j])
            p, q = sx[i] if i < len(sx) else None, sy[j] if j < len(sy) else None
            if across is not None and (p is None or across > p) and (q is None or across >= q):
                return False
            if p is not None and (q is None or p >= q):
                i += 1
            elif q is not None:
                j += 1
            else:
                return True

    def allowed_ids(self, i: int, j: int, a: str, b: str) -> bool:
        got = self.pairs.get(i << 20 | j)
        if got is None:
            got = self.allowed(a, b)
            if len(self.pairs) >= KEPT:
                self.pairs.clear()
            self.pairs[i << 20 | j] = got
        return got

    def path(self, s: str) -> list[str]:
        """The path of weight 0 through a short text: longest piece first, back where no piece may follow."""
        ids, n = self.ids, len(s)
        taken: list[tuple[int, str, int]] = []
        at, end, before, i = 0, min(n, self.longest), "", -1
        while at < n:
            while end > at:
                piece = s[at:end]
                j = ids.get(piece, -1)
                if j >= 0:
                    if not before or (self.allowed_ids(i, j, before, piece) if i >= 0 else self.allowed(before, piece)):
                        break
                elif end == at + 1 and self.allowed(before, piece):
                    break
                end -= 1
            if end > at:
                taken.append((at, before, i))
                at, before, i = end, piece, j
                end = min(n, at + self.longest)
            else:
                end = at - 1
                at, before, i = taken.pop()
        out = [t[1] for t in taken[1:]]
        return [*out, before] if n else out

    def paths(self, s: str, start: int, before: str, stop: int) -> list[str]:
        """For each end from ``start`` to ``stop``: the last piece of the path there ('' if none)."""
        score, allowed, longest = self.score, self.allowed, self.longest
        last = [""] * (stop - start + 1)
        for end in range(start + 1, stop + 1):
            for a in range(max(start, end - longest), end):
                piece = s[a:end]
                if (piece in score or end - a == 1) and (last[a - start] or a == start) and allowed(last[a - start] or before, piece):
                    last[end - start] = piece
                    break
        return last

    def back(self, last: list[str], end: int) -> list[str]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def numbers(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is None:
                out += [self.byte_ids[b] for b in p.encode()]
            else:
                out.append(i)
        return out

    def word(self, raw: bytes) -> list[int]:
        got = self.words.get(raw)
        if got is None:
            got = self.numbers(self.path(raw.decode().replace(" ", MARK)))
            if len(self.words) >= KEPT:
                self.words.clear()
            if len(raw) <= 64:
                self.words[raw] = got
        return got

    def may_follow(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """``allowed_ids`` of pairs of pieces; pairs met lately are kept in ``met``, each in the place that its hash gives."""
        key = i.astype(np.int64) << 20 | j
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MET)).astype(np.int64)
        got = self.met[at]
        new = np.flatnonzero(got >> 1 != key)
        if len(new):
            keys, of = np.unique(key[new], return_inverse=True)
            ok = np.array([self.allowed_ids(k >> 20, k & (1 << 20) - 1, self.names[k >> 20], self.names[k & (1 << 20) - 1]) for k in keys.tolist()], np.int64)
            got[new] = keys[of] << 1 | ok[of]
            self.met[at[new]] = got[new]
        return (got & 1).astype(bool)

    def search(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``path`` of many words at once, a step of each at a time: the piece that starts at each byte (-1: none), and the words left to ``path``.

        These are words with a character that is no piece, and the last few that take the most steps. Byte 255 ends each word.
        """
        tree = self.tree
        first = tree.longest(data)
        taken, origin = np.full(len(data), -1, np.int32), np.full(len(data), -1)
        left = [np.zeros(0, np.int64)]
        k, at, before, j = np.arange(len(start)), start.copy(), np.full(len(start), -1), first[start]
        while len(k) >= FEW:
            ok = j >= 0
            ask = np.flatnonzero(ok & (before >= 0))
            ok[ask] = self.may_follow(taken[before[ask]], j[ask])
            none = np.flatnonzero(j < 0)
            j_next = tree.shorter[j]
            on = np.flatnonzero(ok)
            p = at[on]
            taken[p], origin[p] = j[on], before[on]
            before[on], at[on] = p, p + tree.size[j[on]]
            j_next[on] = first[at[on]]
            # all pieces from here are tried: back to the last one, for which a shorter one may stand
            stuck = (before[none] < 0) | ~tree.single[first[at[none]]]
            left.append(k[none[stuck]])
            back = none[~stuck]
            p = before[back]
            j_next[back] = tree.shorter[taken[p]]
            taken[p] = -1
            at[back], before[back] = p, origin[p]
            going = at < stop[k]
            going[none[stuck]] = False
            k, at, before, j = k[going], at[going], before[going], j_next[going]
        return taken, np.concatenate([*left, k])

    def encoded(self, words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word)."""
        if self.tree is None:
            self.tree, self.names, self.met = Tree(self.ids, len(self.bytes_of)), {i: x for x, i in self.ids.items()}, np.full(1 << MET, -1)
        data, off = text_bytes(words)
        parts, counts, lo = [], [], 0
        while lo < len(words):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SEARCHED, side="right")) - 1)
            own = off[lo : hi + 1] - off[lo]
            start, stop = own[:-1] + np.arange(hi - lo), own[1:] + np.arange(hi - lo)
            taken, left = self.search(np.insert(data[off[lo] : off[hi]], own[1:], 255), start, stop)
            for k in left.tolist():
                taken[start[k] : stop[k]] = -1
            found = np.flatnonzero(taken >= 0)
            count = np.diff(np.searchsorted(found, np.append(start, len(taken))))
            slow = {k: self.word(data[off[lo + k] : off[lo + k + 1]].tobytes()) for k in left.tolist()}
            count[list(slow)] = [len(x) for x in slow.values()]
            by_steps = np.ones(len(count), bool)
            by_steps[list(slow)] = False
            ids, at = np.zeros(count.sum(), np.int32), np.cumsum(count) - count
            ids[np.repeat(by_steps, count)] = taken[found]
            for k, x in slow.items():
                ids[at[k] : at[k] + len(x)] = x
            parts.append(ids)
            counts.append(count)
            lo = hi
        return np.concatenate(parts), np.concatenate(counts)

    # chunks of a giant text, with `longest` characters of context on each side

    def states(self, s: str, at: int) -> list[tuple[int, str]]:
        """(start relative to the boundary, piece): all pieces that end at or straddle the boundary."""
        out = []
        for a in range(max(0, at - self.longest), at):
            for e in range(at, min(len(s), a + self.longest) + 1):
                if s[a:e] in self.score or e - a == 1:
                    out.append((a - at, s[a:e]))
        return out

    def exits(self, s: str, last: list[str], start: int, before: str, at: int) -> np.ndarray:
        """Weights from one entry to the exit states at ``at``."""
        out = []
        for a, piece in self.states(s, at):
            k = at + a - start
            out.append(0.0 if k >= 0 and (k == 0 or last[k]) and self.allowed(last[k] or before, piece) else -np.inf)
        return np.array(out)

    def safe(self, s: str, lo: int, hi: int) -> int:
        """The first boundary from ``lo`` on that no piece straddles, or -1."""
        return next((i for i in range(max(lo, 1), hi) if (s[i] == MARK) != (s[i - 1] == MARK) and s[i] == MARK), -1)

    def transfer(self, s: str, lo: int, hi: int, first: bool, final: bool) -> np.ndarray:
        """Max-plus matrix from the states at ``lo`` to those at ``hi``."""
        entries = [(0, "")] if first else self.states(s, lo)
        meet = self.safe(s, lo, hi)
        stop = meet if meet >= 0 else hi
        whole = None
        if meet >= 0:
            last = self.paths(s, meet, "", hi)
            whole = np.array([0.0]) if final else self.exits(s, last, meet, "", hi)
        rows = []
        for a, piece in entries:
            start = lo + a + len(piece)
            last = self.paths(s, start, piece, stop) if start <= stop else []
            there = bool(last) and (start == stop or bool(last[-1]))
            if meet >= 0:
                rows.append(whole if there else np.full(len(whole), -np.inf))
            elif final:
                rows.append(np.array([0.0 if there else -np.inf]))
            else:
                rows.append(self.exits(s, last, start, piece, hi) if last else np.full(len(self.states(s, hi)), -np.inf))
        return np.stack(rows)

    def trace(self, s: str, lo: int, hi: int, entry: tuple[int, str], leave: tuple[int, str] | None) -> list[int]:
        """Ids of the pieces that start in the chunk."""
        start = lo + entry[0] + len(entry[1])
        end = hi if leave is None else hi + leave[0]
        return self.numbers(self.back(self.paths(s, start, entry[1], end), end - start) + ([leave[1]] if leave else []))


def load(path: str) -> Vocabulary:
    """Reads a SentencePiece model file with byte fallback."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(p.vocab_size())
    score, ids, byte_ids, bytes_of = {}, {}, [0] * 256, []
    for i in every:
        piece = p.id_to_piece(i)
        if p.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            bytes_of.append(bytes([int(piece[3:5], 16)]))
        elif p.is_control(i) or p.is_unknown(i):
            bytes_of.append(b"")
        else:
            score[piece], ids[piece] = p.get_score(i), i
            bytes_of.append(piece.replace(MARK, " ").encode())
    inner = [x for x in score if MARK in x.lstrip(MARK)]
    if inner:
        raise ValueError(f"pieces that go on after a space: {inner[:3]}")
    used = set("".join(x for x in score if len(x) > 1))
    alone = np.array([b < 128 and chr(b) not in used and b != 32 for b in range(256)])
    return Vocabulary(score, ids, byte_ids, bytes_of, max(map(len, score)), alone)


def encode_slice(v: Vocabulary, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of a slice's texts."""
    some = np.flatnonzero(np.diff(off) > 0)
    data = np.insert(data, off[some], 32)
    first = off[some] + np.arange(len(some))
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
    space, alone = data == 32, v.alone[data]
    new = alone.copy()
    new[1:] |= (space[1:] & ~space[:-1]) | alone[:-1]
    new[first] = True
    begin = np.flatnonzero(new)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(data)).astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).dictionary_encode()
    flat, size = v.encoded(words.dictionary)
    at = np.cumsum(size) - size
    code = words.indices.to_numpy()
    n = size[code]
    ends = np.cumsum(n)
    ids = flat[np.repeat(at[code] - (ends - n), n) + np.arange(ends[-1])]
    per = np.zeros(len(off), np.int64)
    per[some + 1] = np.diff(np.append(np.concatenate([[0], ends])[np.searchsorted(begin, first)], ends[-1]))
    return ids, np.cumsum(per)


MATRIX = "__sp_key string, k int, rows int, cells binary"


def packed(m: np.ndarray) -> bytes:
    """A max-plus matrix, whose cells are 0 or minus infinity."""
    return (m.reshape(-1) == 0).tobytes()


def unpacked(cells: bytes, rows: int) -> np.ndarray:
    return np.where(np.frombuffer(cells, bool).reshape(rows, -1), 0.0, -np.inf)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In the max-plus semiring: the best weight from each entry of a to each exit of b."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with two neighbours' matrices (the second null at an odd end): their product."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            m = unpacked(r["cells"], r["rows"])
            if r["cells_b"] is not None:
                m = product(m, unpacked(r["cells_b"], r["rows_b"]))
            out.append((r["__sp_key"], r["k"], len(m), packed(m)))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.binary()))], ["__sp_key", "k", "rows", "cells"])


def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with two factors and the states that enter and leave their product: the state between them."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            key, k, enter, leave = r["__sp_key"], r["k"], r["enter"], r["leave"]
            if r["cells_b"] is None:
                out.append((key, 2 * k, enter, leave))
                continue
            at = int(np.argmax(unpacked(r["cells"], r["rows"])[enter] + unpacked(r["cells_b"], r["rows_b"])[:, leave]))
            out += [(key, 2 * k, enter, at), (key, 2 * k + 1, at, leave)]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int32()))], ["__sp_key", "k", "enter", "leave"])


def scanned(matrices: DataFrame) -> DataFrame:
    """``MATRIX`` of chunks k = 0.. of each text -> the state that enters and leaves each chunk.

    Up: products of neighbours, level by level. Down: the whole text is entered
    and left in its only state; each level gives the states of the one below.
    """

    def pairs(level: DataFrame) -> DataFrame:
        half = lambda odd: level.where(F.col("k") % 2 == odd).withColumn("k", F.floor(F.col("k") / 2).cast("int"))
        second = half(1).select("__sp_key", "k", F.col("rows").alias("rows_b"), F.col("cells").alias("cells_b"))
        return half(0).join(second, ["__sp_key", "k"], "left")

    levels = [cut(matrices)]
    while not levels[-1].where("k > 0").isEmpty():
        levels.append(cut(pairs(levels[-1]).mapInArrow(combined, MATRIX)))
    states = levels[-1].select("__sp_key", "k", F.lit(0).alias("enter"), F.lit(0).alias("leave"))
    for below in reversed(levels[:-1]):
        states = pairs(below).join(states, ["__sp_key", "k"]).mapInArrow(between, "__sp_key string, k int, enter int, leave int")
    states = cut(states)
    drop(*levels)
    return states


def texts_of(lists: pa.Array, size: np.ndarray, flat: np.ndarray) -> pa.Array:
    """The text of each list of ids (null: null); piece i has the next ``size[i]`` bytes of ``flat``."""
    per = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    n = size[ids]
    ends, begin, parts, lo = np.concatenate([[0], np.cumsum(n)]), np.cumsum(size) - size, [], 0
    while lo < len(ids):  # each byte takes two dozen in arrays
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + FINE, side="right")) - 1)
        parts.append(flat[np.repeat(begin[ids[lo:hi]] - ends[lo:hi], n[lo:hi]) + np.arange(ends[lo], ends[hi])].tobytes())
        lo = hi
    out = b"".join(parts)
    at = ends[np.concatenate([[0], np.cumsum(per)])].tolist()
    return pa.array([None if none else out[a + (out[a : a + 1] == b" ") : b].decode("utf-8", "replace") for a, b, none in zip(at[:-1], at[1:], lists.is_null().to_pylist(), strict=True)], pa.string())


def byte_table(bytes_of: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of all pieces' bytes, and these bytes in a row."""
    return np.array([len(b) for b in bytes_of]), np.frombuffer(b"".join(bytes_of), np.uint8)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """All columns of ``docs`` and n_tokens, ids (array<int>)."""
    return _encoded(docs, path, False)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``decode`` of ``encode``; texts that are not giant are encoded and decoded where they are, in one pass."""
    return _encoded(docs, path, True)


def _encoded(docs: DataFrame, path: str, back: bool) -> DataFrame:
    vocabulary = load(path)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    own = docs.drop("ids", "n_tokens", *["decoded"] * back)
    giant = F.coalesce(F.length("text") > CHUNK, F.lit(False))
    schema = StructType([*own.schema.fields, StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType())), *[StructField("decoded", StringType())] * back])

    made = schema.names[len(own.columns) :]

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = byte_table(shared.value.bytes_of)
        for batch in batches:
            texts = column(batch, "text")
            if pc.any(pc.match_substring(texts, MARK)).as_py():
                texts = pc.replace_substring(texts, MARK, " ")
            work = pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "__sp_text"])
            for rows, data, off in slices(work, "__sp_text", TOGETHER):
                ids, at = encode_slice(shared.value, data, off)
                null = column(rows, "text").is_null()
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids), mask=null)
                count = pc.if_else(null, pa.scalar(None, pa.int64()), pa.array(np.diff(at)))
                decoded = [texts_of(lists, *tables)] if back else []
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], count, lists, *decoded], [*rows.schema.names[:-1], *made])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = shared.value.longest
        for batch in batches:
            for key, text in zip(column(batch, "__sp_key").to_pylist(), column(batch, "text"), strict=True):
                s = MARK + text.as_py().replace(" ", MARK)
                n = -(-len(s) // CHUNK)
                for k in range(n):
                    lo, hi = k * CHUNK, min(len(s), (k + 1) * CHUNK)
                    a, b = max(0, lo - wide), min(len(s), hi + wide)
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([k], pa.int32()), pa.array([n], pa.int32()), pa.array([lo - a], pa.int32()), pa.array([hi - a], pa.int32()), pa.array([s[a:b]])], ["__sp_key", "k", "n", "lo", "hi", "s"])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                m = shared.value.transfer(r["s"], r["lo"], r["hi"], r["k"] == 0, r["k"] == r["n"] - 1)
                out.append((r["__sp_key"], r["k"], len(m), packed(m)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int32()), pa.array([x[3] for x in out], pa.binary())], ["__sp_key", "k", "rows", "cells"])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                s, lo, hi = r["s"], r["lo"], r["hi"]
                enter = (0, "") if r["k"] == 0 else v.states(s, lo)[r["enter"]]
                out.append(v.trace(s, lo, hi, enter, None if r["k"] == r["n"] - 1 else v.states(s, hi)[r["leave"]]))
            yield pa.RecordBatch.from_arrays([column(batch, "__sp_key"), column(batch, "k"), pa.array(out, pa.list_(pa.int32()))], ["__sp_key", "k", "ids"])

    key = F.concat_ws("-", F.sha2("text", 256), F.length("text"))
    large = own.where(giant).withColumn("__sp_key", key)
    # equal texts are encoded once
    split_up = large.select("__sp_key", "text").dropDuplicates(["__sp_key"]).mapInArrow(split, "__sp_key string, k int, n int, lo int, hi int, s string")
    pieces = cut(split_up.repartition(fanout(docs), "__sp_key", "k"))
    # chunks by their bytes, some sixteen in a task, and no more tasks than chunks
    tasks = max(1, min(pieces.count(), fanout(pieces, mb=1)))
    states = scanned(pieces.repartition(tasks, "__sp_key", "k").mapInArrow(matrices, MATRIX))
    traced = pieces.join(states, ["__sp_key", "k"]).select("__sp_key", "k", "n", "lo", "hi", "s", "enter", "leave").repartition(tasks, "__sp_key", "k").mapInArrow(trace, "__sp_key string, k int, ids array<int>")
    whole = traced.groupBy("__sp_key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    encoded = large.join(whole, "__sp_key").select(*own.columns, F.size("ids").cast("long").alias("n_tokens"), "ids")
    return own.where(~giant).mapInArrow(small, schema).unionByName(decode(encoded, path) if back else encoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """All columns and ``decoded``: the text of ``ids`` (null: null)."""
    own = encoded.drop("decoded")
    tables = encoded.sparkSession.sparkContext.broadcast(byte_table(load(path).bytes_of))
    schema = StructType([*own.schema.fields, StructField("decoded", StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rows = batch.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([*rows.columns, texts_of(column(rows, "ids"), *tables.value)], [*rows.schema.names, "decoded"])

    return own.mapInArrow(work, schema)
