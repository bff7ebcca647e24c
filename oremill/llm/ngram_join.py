"""N-gram Jaccard join: universe-partition pigeonhole with one-deletion neighbourhoods.

Sizes fall into bands. For a pair whose smaller set is in a band, the sets
differ in at most H elements. Elements are hashed to segments, and a band has
``exact`` segments, which match when they are equal, and ``one`` segments, which
match when one side has at most one element more. With exact + 2 one = H + 1 +
spare, a similar pair without a match in the latter is equal in at least 1 +
spare of the former; so each set may leave out its ``spare`` most frequent exact
segments, in one order for the whole corpus, and a match stays.

Which of these a band gets is decided by cost (``allocate``): candidate
allocations are tried on a bounded sample of the corpus, and what is emitted and
moved is weighed against the company that a set would have in its band. One-
deletion segments are larger, so they pay where sets are many or share much.

Candidates are checked against sizes and parity sketches, which cannot lose a
pair, and then exactly, shingle by shingle, on the texts; only texts of
candidates travel. The first round compares a set with a leader of its groups.
The second looks at groups of which not all are connected yet: large ones are
cut into blocks, and only pairs that pass the sketches leave the task.

Defined results: null and blank texts have empty sets and no links; rows with a
null doc_id are not linked and have a null component; rows that share a doc_id
are one document, linked as soon as one of its texts is; a very long text is
worked on alone; equal sets are linked (by their size and 128 bits of sums);
an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import FINE, MULT, Words, column, pair, slices, spread
from .components import apart_still, components, merged
from .repeats import PACKED, deal, first_of, gather, packed_batch
from .tables import cut, drop, fanout, labelled, sieve, sifted

#: Sets of the sample, and elements of a set at most that it takes; share of it that makes a segment a hot one.
SAMPLE, SAMPLED_SIZE, HOT_SHARE = 2000, 4096, 0.005
#: Cost of a partner in signatures, before texts; sizes beyond which sketches prune nothing.
PARTNER, SKETCHED = 10.0, 1200
SKETCH, BLOCK, PARTNERS = 8, 1024, 128
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Sets:
    """Distinct n-gram hashes of a slice's rows, sorted by row and hash."""

    def __init__(self, data: np.ndarray, off: np.ndarray, n: int):
        w = Words(data, off, lower=True)
        rows = len(off) - 1
        per = np.diff(w.first)
        h = w.hash[: max(0, len(w) - n + 1)] if per.size else w.hash
        for i in range(1, n):
            h = pair(h, w.hash[i : i + len(h)])
        at = np.arange(len(h))
        row = w.row[: len(h)]
        fits = (w.first[row + 1] - at >= n) if len(h) else np.zeros(0, bool)
        h, row = h[fits], row[fits]
        short = np.flatnonzero((per > 0) & (per < n))
        if len(short):
            whole = w.hash[w.first[short]]
            for i in range(1, n - 1):
                more = per[short] > i
                whole[more] = pair(whole[more], w.hash[w.first[short[more]] + i])
            h, row = np.concatenate([h, spread(whole + per[short].astype(np.uint64) * MULT[9])]), np.concatenate([row, short])
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        self.hash, self.row = h[new], row[new]
        self.size = np.bincount(self.row, minlength=rows)


class Some:
    """Sets given as arrays of hashes."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.hash = np.concatenate([*sets, np.zeros(0, np.uint64)]).astype(np.uint64)
        self.row = np.repeat(np.arange(len(sets)), self.size)


@lru_cache
def edges(percent: int) -> np.ndarray:
    """Least size of each band; a set's partners' sizes lie in its band or the one below."""
    ratio, out = max(1.25, 120 / percent), [1]
    while out[-1] < 1 << 31:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return np.array(out)


def differing(percent: int) -> np.ndarray:
    """H of each band: elements in which a similar pair differs at most when its smaller set is there."""
    return (edges(percent)[1:] - 1) * (100 - percent) // percent


@dataclass
class Plan:
    """``bands``: exact, one, spare of each band; ``hot``: frequent signatures, sorted, and their frequencies."""

    percent: int
    bands: np.ndarray
    hot: np.ndarray
    heat: np.ndarray


def in_band(s: Sets | Some, use: np.ndarray, exact: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, ...]:
    """(signature, row, part, whether a neighbour's) of the sets in their bands ``use`` (negative: none)."""
    has = (s.size > 0) & (use >= 0)
    b = np.where(has, use, 0)
    m = np.where(has, exact + one, 0)
    base = np.cumsum(m) - m
    own = np.flatnonzero(has[s.row])
    r = s.row[own]
    segment = ((s.hash[own] >> np.uint64(20)) % m[r].astype(np.uint64)).astype(np.int64)
    slot = base[r] + segment
    mixed = spread(s.hash[own] + MULT[11])
    total = np.zeros(int(m.sum()), np.uint64)
    np.add.at(total, slot, mixed)
    count = np.bincount(slot, minlength=len(total))
    row_of = np.repeat(np.arange(len(m)), m)
    part = np.arange(len(total)) - base[row_of]

    # a segment's key besides its elements: band, segments of the band, number, how many
    def tag(t: np.ndarray, c: np.ndarray, k: np.ndarray) -> np.ndarray:
        return spread(t + ((b[row_of[k]] << 34) + (part[k] << 1)).astype(np.uint64) * MULT[12] + c.astype(np.uint64) * MULT[13])

    near = np.flatnonzero(segment < one[r])
    k = slot[near]
    sig = np.concatenate([tag(total, count, np.arange(len(total))), tag(total[k] - mixed[near], count[k] - 1, k)])
    return sig, np.concatenate([row_of, r[near]]), np.concatenate([part, part[k]]), np.arange(len(sig)) >= len(total)


def bands_of(size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The band of each size, and the lowest that a partner can be in."""
    e = edges(percent)
    return np.searchsorted(e, size, side="right") - 1, np.searchsorted(e, np.maximum(-(-size * percent // 100), 1), side="right") - 1


def partners(sig: np.ndarray, row: np.ndarray, rows: int) -> int:
    """Distinct pairs of rows that share a signature."""
    order = np.lexsort((row, sig))
    sig, row = sig[order], row[order]
    found, lag = np.zeros(0, np.int64), 1
    while lag < len(sig):
        k = np.flatnonzero(sig[lag:] == sig[:-lag])
        if not len(k):
            break
        found = np.union1d(found, (row[k] * rows + row[k + lag])[row[k] != row[k + lag]])
        lag += 1
    return len(found)


def left_out(sig: np.ndarray, row: np.ndarray, loose: np.ndarray, spare: int) -> np.ndarray:
    """Which signatures stay when each row leaves out its ``spare`` most frequent loose ones."""
    _, of, often = np.unique(sig, return_inverse=True, return_counts=True)
    order = np.lexsort((sig, -often[of], ~loose, row))
    rank = np.arange(len(sig)) - np.searchsorted(row[order], row[order])
    stays = np.ones(len(sig), bool)
    stays[order] = (rank >= spare) | ~loose[order]
    return stays


def allocate(percent: int, counts: np.ndarray, sample: list[np.ndarray]) -> np.ndarray:
    """Exact segments, one-deletion segments and spare of each band, by cost.

    ``counts`` is the number of sets that each band compares. A set's cost in a
    band is its signatures and ``PARTNER`` times its partners, those of
    large sets more, as sketches don't spare their texts. Partners are counted
    on the sample and scaled to the band's number of sets; what the sample is
    too small to show, empty segments above all, is added by formula.
    """
    e, out = edges(percent), []
    sizes = np.array([len(s) for s in sample])
    own, low = bands_of(sizes, percent) if len(sample) else (sizes, sizes)
    for b, most in enumerate(differing(percent).tolist()):
        n = float(e[b] + e[b + 1] - 1) / 2
        price = PARTNER + (n if n > SKETCHED else 0)
        picked = np.flatnonzero((own == b) | ((own == b + 1) & (low <= b)))[: max(2, int(2e5 / n))] if len(sample) else []
        some = Some([sample[i] for i in picked])
        best = None
        for one in sorted({0, *(-(-(most + 1) * k // 8) // 2 for k in (1, 2, 4)), (most + 2) // 2}):
            for spare in sorted({0, most // 16, most // 8, most // 4, min(most, 2)}):
                exact = max(0, most + 1 - 2 * one) + (spare if 2 * one <= most else 0)
                if spare and 2 * one > most:
                    continue
                m = exact + one
                full, empty = n / m, m * np.exp(-n / m)
                bare = np.exp(-2 * n / m) * (exact * max(0.0, 1 - spare / empty) + one * (1 + 2 * full)) * counts[b]
                cost = exact + one * (1 + full) + price * bare
                if best is not None and cost >= best[0]:
                    continue
                if len(picked) > 1:
                    k = np.full(len(picked), 1)
                    sig, row, part, _ = in_band(some, k * b, k * exact, k * one)
                    stays = left_out(sig, row, part >= one, spare)
                    met = 2 * partners(sig[stays], row[stays], len(picked)) / len(picked)
                    cost += price * met * max(counts[b], len(picked)) / len(picked)
                if best is None or cost < best[0]:
                    best = (cost, exact, one, spare)
        out.append(best[1:])
    return np.array(out)


#: What a signature may do: stay whatever its frequency, or be left out in the set's own band or the one below.
TIGHT, OWN, BELOW = 0, 1, 2


def signatures(s: Sets | Some, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, row, kind, how many more of the kind may be left out, whether it is hot) of all rows' segments.

    Hot ones are left out here, hottest first, as far as the band's spare goes.
    """
    band, lowest = bands_of(s.size, plan.percent)
    out = []
    for back in range(2):
        use = np.where(band - back >= lowest, band - back, -1)
        exact, one, spare = (plan.bands[np.maximum(use, 0), i] for i in range(3))
        sig, row, part, near = in_band(s, use, exact, one)
        loose = (part >= one[row]) & ~near
        at = np.minimum(np.searchsorted(plan.hot, sig), max(len(plan.hot) - 1, 0))
        hot = plan.hot[at] == sig if len(plan.hot) else np.zeros(len(sig), bool)
        k = np.flatnonzero(hot & loose)
        k = k[np.lexsort((~sig[k].view(np.int64), -plan.heat[at[k]], row[k]))] if len(k) else k
        rank = np.arange(len(k)) - np.searchsorted(row[k], row[k])
        gone = k[rank < spare[row[k]]]
        left = spare - np.bincount(row[gone], minlength=len(spare))
        stays = np.ones(len(sig), bool)
        stays[gone] = False
        kind = np.where(loose, OWN + back, TIGHT)
        out.append((sig[stays], row[stays], kind[stays], left[row[stays]], hot[stays]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def planned(percent: int, counts: np.ndarray, sample: list[np.ndarray]) -> Plan:
    plan = Plan(percent, allocate(percent, counts, sample), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    sig = signatures(Some(sample), plan)[0]
    found, often = np.unique(sig, return_counts=True)
    hot = often >= max(8, HOT_SHARE * len(sample))
    return Plan(percent, plan.bands, found[hot], often[hot])


PROFILE = "doc_id long, n_shingles long, same long, other long, sketch array<long>, elements binary, wide binary"
#: Sets of more elements than the bits of a sketch have a wide one too.
WIDE = SKETCH * 64


def wide_sketches(s: Sets) -> list[bytes | None]:
    """Parities of large sets' elements in as many bits as the next power of two; null for others."""
    at, out = np.concatenate([[0], np.cumsum(s.size)]), []
    for i, n in enumerate(s.size.tolist()):
        if n <= WIDE:
            out.append(None)
            continue
        bits = 1 << (n - 1).bit_length()
        odd = np.bincount((spread(s.hash[at[i] : at[i + 1]] + MULT[24]) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(bool), bitorder="little").tobytes())
    return out


def differing_bits(a: bytes, b: bytes) -> int:
    """Places in which two wide sketches differ, the longer one folded; no more than the elements in which the sets do."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, n), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def profiles(docs: DataFrame, n: int, share: float) -> DataFrame:
    """``PROFILE``: size, 128 bits of sums of the set, a 512-bit sketch of element parities; elements of the sample."""
    picked = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))) & F.col("doc_id").isNotNull()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in slices(batch, limit=FINE):
                s = Sets(data, off, n)
                sums = np.zeros((2, rows.num_rows), np.uint64)
                np.add.at(sums[0], s.row, spread(s.hash + MULT[21]))
                np.add.at(sums[1], s.row, spread(s.hash + MULT[23]))
                bit = spread(s.hash + MULT[22])
                sketch = np.zeros((rows.num_rows, SKETCH), np.uint64)
                np.bitwise_xor.at(sketch, (s.row, (bit >> np.uint64(61)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sketch.size + 1, SKETCH, dtype=np.int32)), pa.array(sketch.reshape(-1).view(np.int64)))
                wanted = column(rows, "__picked").to_numpy(zero_copy_only=False).astype(bool) & (s.size > 0) & (s.size <= SAMPLED_SIZE)
                at = np.concatenate([[0], np.cumsum(s.size)])
                elements = [s.hash[at[i] : at[i + 1]].tobytes() if wanted[i] else None for i in range(rows.num_rows)]
                yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), pa.array(s.size), *(pa.array(x.view(np.int64)) for x in sums), lists, pa.array(elements, pa.binary()), pa.array(wide_sketches(s), pa.binary())], [f.split()[0] for f in PROFILE.split(", ")])

    return docs.select("doc_id", "text", F.coalesce(picked, F.lit(False)).alias("__picked")).mapInArrow(work, PROFILE)


COMPANY = "sig long, doc long, many long, kind int, left int"


def companies(docs: DataFrame, n: int, plan: Plan) -> DataFrame:
    """``COMPANY``: the signatures that several documents have, and how many do.

    Hot signatures are dealt by document as well, so no task gets all of one;
    the sample's frequency, above all others, is their number.
    """
    parts = fanout(docs, 2.0)
    buckets = 1 << max(8, (parts - 1).bit_length())
    kinds = ["<u8", "<i8", "u1", "<u2", "?"]
    shared = docs.sparkSession.sparkContext.broadcast(plan)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, _ in slices(batch):
                # signatures are found in finer slices and dealt together
                found = []
                for part, data, off in slices(rows, limit=FINE):
                    sig, row, kind, left, hot = signatures(Sets(data, off, n), shared.value)
                    doc = column(part, "doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                    found.append((sig, doc[row], kind.astype("u1"), np.minimum(left, 65535).astype("<u2"), hot))
                sig, d, kind, left, hot = (np.concatenate(x) for x in zip(*found, strict=True))
                at = np.where(hot, spread(sig ^ d.astype(np.uint64) * MULT[31]), sig)
                yield packed_batch(list(deal((at & np.uint64(buckets - 1)).astype(np.int64), buckets, sig, d, kind, left, hot)))

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, doc, kind, left, hot = gather(batches, kinds)
        order = np.argsort(sig, kind="stable")
        sig, doc, kind, left, hot = (x[order] for x in (sig, doc, kind, left, hot))
        if not len(sig):
            return
        _, of = first_of(sig)
        many = np.bincount(of)[of]
        if len(shared.value.hot):
            at = np.minimum(np.searchsorted(shared.value.hot, sig), len(shared.value.hot) - 1)
            many = np.where(hot, (1 << 48) + shared.value.heat[at], many)
        keep = many > 1
        sig, doc, many, kind, left = (x[keep] for x in (sig, doc, many, kind, left))
        for lo in range(0, len(sig), 1 << 16):
            to = slice(lo, lo + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(sig[to].view(np.int64)), pa.array(doc[to]), pa.array(many[to]), pa.array(kind[to].astype(np.int32)), pa.array(left[to].astype(np.int32))], [f.split()[0] for f in COMPANY.split(", ")])

    return docs.where("doc_id is not null").mapInArrow(emit, PACKED).repartition(parts, "bucket").mapInArrow(group, COMPANY)


def may_link(a: str, b: str, percent: int) -> Column:
    """Sizes and sketches allow a similarity of ``percent``: parities differ in no more places than the sets."""
    size = lambda x: F.col(f"{x}.n_shingles")
    apart = sum((F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(SKETCH)), F.lit(0))
    near = F.least(size(a), size(b)) * 100 >= F.greatest(size(a), size(b)) * percent
    return near & (apart * (100 + percent) <= (size(a) + size(b)) * (100 - percent))


def shingles(text: str, n: int) -> set[tuple[bytes, ...]]:
    w = text.encode().translate(LOWER).split()
    return set(zip(*(w[i:] for i in range(n)), strict=False)) if len(w) >= n else ({tuple(w)} if w else set())


def verified(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose texts' shingles are similar enough.

    Texts of candidates, and only theirs, are joined with the list of documents
    a that they are to be compared with and travel once to each; one with many
    partners has several tasks of ``PARTNERS`` at most.
    """
    pairs = cut(pairs)
    parts = fanout(docs)
    busy = pairs.groupBy("a").agg(F.count("*").alias("n"), F.ceil(F.count("*") / PARTNERS).cast("int").alias("salts"))
    salted = labelled(pairs, ["a"], busy, "n", pairs.count()).select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.col("b").alias("id"))
    routes = salted.select("id", F.struct("a", "salt", F.lit(1).alias("role")).alias("to"))
    each = busy.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    routes = routes.unionByName(each.select(F.col("a").alias("id"), F.struct("a", "salt", F.lit(0).alias("role")).alias("to")))
    routes = cut(routes.groupBy("id").agg(F.collect_list("to").alias("to")))
    texts = sifted(docs.where("doc_id is not null"), sieve(routes.select("id")), "doc_id")
    sent = texts.join(routes, texts.doc_id == routes.id).select("doc_id", "text", F.explode("to").alias("to")).select("to.*", "doc_id", "text")
    sent = sent.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "role")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, leaders = None, []
        for batch in batches:
            found = []
            for a, salt, role, doc, text in zip(*(column(batch, c).to_pylist() for c in ("a", "salt", "role", "doc_id")), column(batch, "text"), strict=True):
                if (a, salt) != current:
                    current, leaders = (a, salt), []
                own = shingles(text.as_py() or "", n)
                if role == 0:
                    leaders.append(own)
                elif any(own and 100 * (both := len(own & x)) >= percent * (len(own) + len(x) - both) and both for x in leaders):
                    found.append((a, doc))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(2)], ["a", "b"])

    out = cut(sent.mapInArrow(judge, "a long, b long").distinct())
    drop(pairs, routes)
    return out


MEMBER = "sig long, c long, doc long, n_shingles long, sketch array<long>"


def apart(percent: int):
    """Of blocks of a group: the pairs of different components that sizes and sketches allow."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks().to_batches()[0]
        sig, i, j, own, c, doc, size = (column(t, x).to_numpy(zero_copy_only=False) for x in ("sig", "i", "j", "own", "c", "doc", "n_shingles"))
        words = column(t, "sketch").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, SKETCH)
        order = np.lexsort((own, j, i, sig))
        sig, i, j, own, c, doc, size, words = (x[order] for x in (sig, i, j, own, c, doc, size, words))
        wide = column(t, "wide").take(pa.array(order)).to_pylist()
        begin, _ = first_of(sig, i, j)
        for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(sig)], strict=True):
            across = i[lo] != j[lo]
            mid = lo + int(np.searchsorted(own[lo:hi], j[lo])) if across else hi
            for at in range(lo, mid, 256):
                mine, start = np.arange(at, min(at + 256, mid)), mid if across else at
                other = np.arange(start, hi)
                least, most = np.minimum(size[mine, None], size[other]), np.maximum(size[mine, None], size[other])
                ok = (least * 100 >= most * percent) & (c[mine, None] != c[other]) & (mine[:, None] < other)
                far = sum(np.bitwise_count(words[mine, None, k] ^ words[None, other, k]).astype(np.int64) for k in range(SKETCH))
                x, y = np.nonzero(ok & (far * (100 + percent) <= (least + most) * (100 - percent)))
                x, y = mine[x], other[y]
                # sketches of large sets are full, so they are compared by their wide ones
                large = np.flatnonzero((size[x] > WIDE) & (size[y] > WIDE))
                near = np.ones(len(x), bool)
                near[large] = [differing_bits(wide[i], wide[j]) * (100 + percent) <= int(size[i] + size[j]) * (100 - percent) for i, j in zip(x[large].tolist(), y[large].tolist(), strict=True)]
                a, b = doc[x[near]], doc[y[near]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return work


def join_ngrams(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    number = docs.count()
    profile = cut(profiles(docs, n, min(1.0, SAMPLE / max(number, 1))))
    known = profile.where("doc_id is not null and n_shingles > 0").drop("elements")
    # equal sets are one: the document of the least id stands for all of them
    key = ["n_shingles", "same", "other"]
    classes = cut(known.groupBy(*key).agg(F.min("doc_id").alias("doc"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide"), F.count("*").alias("copies")))
    e = [int(x) for x in edges(percent)[:-1]]
    band = F.array_size(F.filter(F.array(*[F.lit(x) for x in e]), lambda x: x <= F.col("n_shingles"))) - 1
    counts = np.zeros(len(e) + 1)
    for r in classes.groupBy(band.alias("band")).count().collect():  # one row a band
        counts[r["band"]] += r["count"]
    # at most 2 * SAMPLE sets of at most SAMPLED_SIZE elements
    sample = [np.frombuffer(bytes(r[0]), np.uint64) for r in profile.where("elements is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "same").limit(2 * SAMPLE).select("elements").collect()]
    plan = planned(percent, counts[:-1] + counts[1:], sample)

    seen = companies(docs, n, plan)
    # equal sets' other documents go; each set leaves out its most frequent segments
    by_doc = seen.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("kind", "many", "sig", "left"))).alias("all"))
    by_doc = by_doc.join(classes.select("doc").distinct(), "doc", "left_semi")

    def stay(kind: int) -> Column:
        mine = F.filter("all", lambda x: x["kind"] == kind)
        spare = F.coalesce(F.array_min(F.transform(mine, lambda x: x["left"])), F.lit(0))
        return F.transform(F.slice(mine, F.lit(1), F.greatest(F.size(mine) - spare, F.lit(0))), lambda x: x["sig"])

    tight = F.transform(F.filter("all", lambda x: x["kind"] == TIGHT), lambda x: x["sig"])
    company = cut(by_doc.select("doc", F.explode(F.array_union(F.array_union(stay(OWN), stay(BELOW)), tight)).alias("sig")))
    total = company.count()

    # first round: each set with the leader that it meets most, then with the least of its leaders where that is in another component still
    leaders = company.groupBy("sig").agg(F.min("doc").alias("a"), F.max("doc").alias("z"), F.count("*").alias("members")).where("a != z").drop("z")
    met = labelled(company, ["sig"], leaders, "members", total).where("doc != a").groupBy("doc", "a").count()
    met = cut(met.groupBy("doc").agg(F.min("a").alias("least"), F.max_by("a", F.struct("count", -F.col("a"))).alias("most")))
    sketched = classes.select("doc", "n_shingles", "sketch")

    def compared(pairs: DataFrame) -> DataFrame:
        c = pairs.alias("c").join(sketched.alias("x"), F.col("c.a") == F.col("x.doc")).join(sketched.alias("y"), F.col("c.b") == F.col("y.doc"))
        return verified(docs, c.where(may_link("x", "y", percent)).select("c.a", "c.b").distinct(), n, percent)

    label = components(compared(met.select(F.col("most").alias("a"), F.col("doc").alias("b"))))
    rest = met.where("least != most").select(F.col("least").alias("a"), F.col("doc").alias("b"))
    rest = compared(apart_still(label, rest))
    # an id with several texts links the sets of all of them
    several = known.groupBy("doc_id").agg(F.min("same").alias("s"), F.max("same").alias("t")).where("s != t").select("doc_id")
    ties = known.join(several, "doc_id", "left_semi").select("doc_id", *key).distinct().join(classes, key).select(F.col("doc").alias("a"), F.col("doc_id").alias("b"))
    label = merged(label, cut(rest.unionByName(ties)))

    # second round: sets of one group that are in different components
    marked = company.join(label, company.doc == label.id, "left").select("sig", "doc", F.coalesce("component", "doc").alias("c"))
    marked = cut(marked)
    open_ = marked.groupBy("sig").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count("*").alias("members")).where("c1 != c2").select("sig", "members")
    members = labelled(marked, ["sig"], open_, "members", total).join(classes.select("doc", "n_shingles", "sketch", "wide"), "doc")
    members = members.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("doc", "sketch"), F.col("blocks")).cast("int"))
    members = members.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("sig", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"), "own", "c", "doc", "n_shingles", "sketch", "wide")
    parts = fanout(docs)
    second = verified(docs, members.repartition(parts, "sig", "i", "j").mapInArrow(apart(percent), "a long, b long").distinct(), n, percent)
    final = merged(label, second)
    drop(company, marked, met)

    named = classes.join(final, classes.doc == final.id, "left").select(*key, "copies", F.coalesce("component", "doc").alias("component"))
    rows = profile.select("doc_id", *key)
    full = labelled(rows.where("doc_id is not null and n_shingles > 0"), key, named, "copies", number).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    bare = rows.where("doc_id is null or n_shingles = 0")
    bare = bare.join(final, bare.doc_id == final.id, "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return full.unionByName(bare)
