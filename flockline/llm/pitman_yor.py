"""LM scoring by a hierarchical Pitman-Yor model whose seating is sampled by Gibbs.

Two levels of Chinese restaurants: one for each context (the word before, by its
exact hash, or a text's start), and their common parent, whose base is uniform
over the V known tokens and one unknown. A sweep draws the tables of each dish of a
context from their exact conditional, given the parent and the other dishes' tables
of the sweep before; then it draws those of each dish in the parent. Both discounts
are one half.

Tokens travel once, in compressed blocks, to buckets: a rare word's tokens by the
word, a common word's by the context where that is rare and else by word and
context, so that neither a common word nor a common context meets in one task.
All tasks know the tables of each common word and common context. Those of rare
contexts, whose number grows with the input, are summed by context after every
sweep and joined to the buckets that have them; contexts without a repeated pair
keep theirs and travel once. Strengths are resampled after every sweep.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flockline.llm.common import discard, written

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: No word is a line feed, so it stands for the end.
END = xxhash.xxh3_64_intdigest(b"\n")
#: At most so many words are common: the bound of what is broadcast.
COMMON = 100_000
CHUNK_TOKENS = 500_000
CHUNK_DOCS = 65_000
BUCKET_TOKENS = 500_000
#: Documents whose partial sums a scoring task holds before it passes them on.
HELD_DOCS = 400_000
#: Of the root and of contexts. At one half the number of seatings has a closed form, so that tables are drawn exactly for any count.
DISCOUNTS = (0.5, 0.5)
#: Restaurants are drawn for together up to so many customers or tables, and one by one from there on; the distribution is the same.
TOGETHER = 4096
DOC_BITS = 17


def packed(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, 5), 3)


def unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(zstandard.decompress(blob))


def spread(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(29))


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


@dataclass
class Chunk:
    """Consecutive documents of a partition: ids, and the hashes of their tokens."""

    number: int
    ids: list = field(default_factory=list)
    tokens: list[np.ndarray] = field(default_factory=list)
    size: int = 0

    def lengths(self) -> np.ndarray:
        return np.array([len(x) for x in self.tokens])


def chunks(batches: Iterator[pa.RecordBatch], train_only: bool) -> Iterator[Chunk]:
    """From rows (partition, doc_id, text). A chunk ends at CHUNK_TOKENS or CHUNK_DOCS; a longer text is one by itself."""
    cache: dict[bytes, int] = {}
    chunk = None
    for b in batches:
        for part, doc, text in zip(b.column(0), b.column(1), b.column(2), strict=True):
            if chunk is None:
                chunk = Chunk(part.as_py() << 32)
            doc = doc.as_py()
            if train_only and held_out(doc):
                continue
            hashes = []
            for w in (text.as_py() or "").encode("utf-8", "surrogatepass").translate(LOWER).split():
                h = cache.get(w)
                if h is None:
                    if len(cache) > 150_000:
                        cache.clear()
                    h = cache[w] = xxhash.xxh3_64_intdigest(w)
                hashes.append(h)
            hashes.append(END)
            if chunk.ids and (chunk.size + len(hashes) > CHUNK_TOKENS or len(chunk.ids) >= CHUNK_DOCS):
                yield chunk
                chunk = Chunk(chunk.number + 1)
            chunk.ids.append(doc)
            chunk.tokens.append(np.array(hashes, np.uint64))
            chunk.size += len(hashes)
    if chunk is not None and chunk.ids:
        yield chunk


@dataclass(frozen=True)
class Words:
    """What every task knows: sizes, and the common words by hash with their training counts."""

    n: int
    v: int
    hashes: np.ndarray  # sorted
    counts: np.ndarray
    buckets: int

    @property
    def contexts(self) -> int:
        """Those that all tasks know: the common words and, last, a text's start. A bucket numbers its rare contexts from here on."""
        return len(self.hashes) + 1


def counted(docs: DataFrame) -> Words:
    """Exact counts of all training tokens; the common words are those of at least the least count that keeps them within COMMON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, train_only=True):
            h, c = np.unique(np.concatenate(chunk.tokens), return_counts=True)
            for at in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[at : at + 100_000].view(np.int64)), pa.array(c[at : at + 100_000].astype(np.int64))], ["h", "c"])

    counts = written(docs.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "lm-words")
    step = F.floor(F.log2("c") * 8).cast("int")
    steps = sorted(((r[0], r[1], r[2], r[3]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)), F.sum("c"), F.min("c")).collect()), reverse=True)
    room, least = COMMON, None
    for _, words, _, low in steps:
        room -= words
        if room < 0:
            break
        least = low
    common = counts.filter(F.col("c") >= least).collect() if least is not None else []
    discard(counts)
    h = np.array([r[0] for r in common], np.int64).view(np.uint64)
    order = np.argsort(h)
    n = sum(s[2] for s in steps)
    return Words(n, sum(s[1] for s in steps), h[order], np.array([r[1] for r in common], np.int64)[order], max(1, math.ceil(n / BUCKET_TOKENS)))


def dealt(docs: DataFrame, known: Words) -> DataFrame:
    """A row a bucket, with its pairs of word and context and where they occur, and a row a chunk with its documents."""
    bits = np.int64(DOC_BITS)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, train_only=False):
            lengths = chunk.lengths()
            train = np.array([not held_out(d) for d in chunk.ids])
            h = np.concatenate(chunk.tokens)
            doc = np.repeat(np.arange(len(lengths), dtype=np.int64) << np.int64(1) | train, lengths)
            at = np.minimum(np.searchsorted(known.hashes, h), max(len(known.hashes) - 1, 0))
            common = known.hashes[at] == h if len(known.hashes) else np.zeros(len(h), bool)
            firsts = np.cumsum(lengths) - lengths
            near, context, before = np.roll(common, 1), np.roll(at, 1), np.roll(h, 1)
            near[firsts], context[firsts] = True, known.contexts - 1
            both = common & near
            code = at[both].astype(np.int64) * known.contexts + context[both]
            place, whole = spread(code) % np.uint64(known.buckets), code << bits | doc[both]
            kind = np.where(near, 1, np.where(common, 2, 3))[~both]  # rare: the word, the context, both
            key = np.where(common, before, h)[~both]
            known_one = np.select([kind == 1, kind == 2], [context[~both], at[~both]], 0).astype(np.int64)
            rest, other = (known_one << np.int64(2) | kind) << bits | doc[~both], before[~both]
            rare_place = spread(key) % np.uint64(known.buckets)
            by, rare_by = np.argsort(place, kind="stable"), np.argsort(rare_place, kind="stable")
            cuts, rare_cuts = np.searchsorted(place[by], np.arange(known.buckets + 1)), np.searchsorted(rare_place[rare_by], np.arange(known.buckets + 1))
            for k in np.union1d(place, rare_place).astype(int).tolist():
                some, few = np.sort(whole[by[cuts[k] : cuts[k + 1]]]), rare_by[rare_cuts[k] : rare_cuts[k + 1]]
                few = few[np.argsort(key[few], kind="stable")]
                yield row(k, chunk.number, packed(np.diff(some, prepend=np.int64(0)), np.diff(key[few], prepend=np.uint64(0)), rest[few], other[few][kind[few] == 3]))
            # What common words add to the base score is known here.
            owner = (doc >> 1)[common]
            base = np.bincount(owner, np.log10(known.counts[at[common]] + 0.1) if len(owner) else None, len(lengths))
            yield row(-1 - chunk.number % known.buckets, chunk.number, pickle.dumps((chunk.ids, lengths, train, base, np.bincount(owner, minlength=len(lengths)))))

    def row(bucket: int, chunk: int, blob: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([chunk], pa.int64()), pa.array([blob], pa.binary())], ["bucket", "chunk", "blob"])

    def gather(rows: pa.Table) -> pa.Table:
        bucket, none = rows.column("bucket")[0].as_py(), pa.nulls(rows.num_rows, pa.binary())
        if bucket < 0:
            return pa.table({"bucket": rows.column("bucket"), "chunk": rows.column("chunk"), "pairs": none, "places": rows.column("blob")})
        rows = rows.sort_by("chunk")
        codes, docs_, keys, rests, others, of, rare_of = [], [], [], [], [], [], []
        for i, blob in enumerate(rows.column("blob")):
            some, key, rest, other = unpacked(blob.as_buffer())
            some = np.cumsum(some)
            codes.append(some >> bits)
            docs_.append((some & ((1 << DOC_BITS) - 1)).astype(np.int32))
            of.append(np.full(len(some), i, np.int32))
            with np.errstate(over="ignore"):
                keys.append(np.cumsum(key, dtype=np.uint64))
            rests.append(rest)
            others.append(other)
            rare_of.append(np.full(len(key), i, np.int32))
        names, spot = np.unique(np.concatenate(codes), return_inverse=True)
        key, rest = np.concatenate(keys), np.concatenate(rests)
        kind, w, u = rest >> bits & 3, rest >> (bits + 2), rest >> (bits + 2)
        rare_docs = [(rest & ((1 << DOC_BITS) - 1)).astype(np.int32)]
        w[kind != 2] = len(known.hashes) + np.unique(key[kind != 2], return_inverse=True)[1]
        key[kind == 3] = np.concatenate(others)
        far, which = np.unique(key[kind != 1], return_inverse=True)
        u[kind != 1] = known.contexts + which
        rare_names, rare_spot = np.unique(w * (known.contexts + len(far)) + u, return_inverse=True)
        spot = np.concatenate([spot, rare_spot + len(names)]).astype(np.int32)
        doc = np.concatenate([*docs_, *rare_docs])
        n_pairs = len(names) + len(rare_names)
        c = np.bincount(spot, doc & 1, n_pairs).astype(np.int64)
        of = np.concatenate([*of, *rare_of])
        order = np.argsort(of, kind="stable")
        chunk = np.array(rows.column("chunk").to_pylist(), np.int64)
        pairs = packed(np.diff(names, prepend=0), np.diff(rare_names, prepend=0), c.astype(np.int32) if c.max(initial=0) < 2**31 else c, np.diff(far, prepend=np.uint64(0)))
        places = packed(chunk, np.searchsorted(of[order], np.arange(len(chunk) + 1)), np.diff(spot[order], prepend=np.int32(0)), (doc[order] >> 1).astype(np.uint16))
        return pa.table({"bucket": pa.array([bucket], pa.int64()), "chunk": pa.nulls(1, pa.int64()), "pairs": pa.array([pairs], pa.binary()), "places": pa.array([places], pa.binary())})

    rows = docs.mapInArrow(deal, "bucket long, chunk long, blob binary")
    return written(rows.groupBy("bucket").applyInArrow(gather, "bucket long, chunk long, pairs binary, places binary"), "lm-buckets")


def pairs_of(blob: bytes, known: Words) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """A bucket's pairs: common word or -1 less the rare word's number, context, training count; and the hashes of its rare contexts."""
    common, rest, c, far = unpacked(blob)
    common, rest = np.cumsum(common), np.cumsum(rest)
    with np.errstate(over="ignore"):
        far = np.cumsum(far, dtype=np.uint64)
    rare, n = rest // (known.contexts + len(far)), len(known.hashes)
    w = np.concatenate([common // known.contexts, np.where(rare < n, rare, n - 1 - rare)])
    return (w.astype(np.int32), np.concatenate([common % known.contexts, rest % (known.contexts + len(far))]).astype(np.int32), c), far


def far_of(states: list | None, n: int, passes: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of a bucket's n rare contexts: their tables after each pass so far, their customers, and whether their tables may change."""
    known = {x["sweep"]: unpacked(x["blob"]) for x in states or []}
    first, customers, moves = known.get(0, (np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)))
    tables = []
    for k in range(passes):
        tables.append(first.copy())
        if k and moves.any():
            tables[-1][moves] = known[k][0]
    return tables, customers, moves


def seated(customers: np.ndarray, others: np.ndarray, parent: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A Gibbs draw of the tables that the customers of each dish take, given all others.

    ``others`` is the strength and one half of the other dishes' tables, ``parent`` the
    parent's probability of the dish. With discount 1/2, c customers sit at t tables in
    ways whose weights sum to S(c, t), where S(c, t + 1) / S(c, t) = 4 (c - t) / (t (2 c - t - 1)).
    So the odds of t + 1 to t tables are that ratio times (others + t / 2) * parent. They
    fall with t: the mode is found by bisection, and from there outwards each number
    takes the place of the one drawn so far with its share of the weight so far, until
    what is left is below double precision.
    """
    tables = np.minimum(customers, 1)
    many = np.flatnonzero(customers > 1)
    c, a, p = customers[many].astype(float), others[many], parent[many]

    def odds(t: np.ndarray, i: np.ndarray | slice = slice(None)) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return (a[i] + t / 2) * p[i] * 4 * (c[i] - t) / (t * (2 * c[i] - t - 1))

    low, high = np.ones(len(c)), c.copy()
    while (low < high).any():
        middle = np.floor((low + high) / 2)
        up = odds(middle) >= 1
        low, high = np.where(up & (low < high), middle + 1, low), np.where(up, high, middle)
    mode, drawn, total = low, low.copy(), np.ones(len(c))
    for way in (1, -1):
        i, t, w = np.arange(len(c)), mode.copy(), np.ones(len(c))
        while len(i):
            w = w * odds(t, i) if way > 0 else w / odds(t - 1, i)
            t = t + way
            going = w > 1e-17 * total[i]
            i, t, w = i[going], t[going], w[going]
            total[i] += w
            moved = rng.random(len(i)) * total[i] < w
            drawn[i[moved]] = t[moved]
    tables[many] = drawn.astype(tables.dtype)
    return tables


@dataclass(frozen=True)
class Sweep:
    """What a sweep leaves for all: tables by common context, tables and root tables of the common words, strengths (root, context), root totals."""

    tables: np.ndarray
    common: np.ndarray
    common_root: np.ndarray
    strengths: tuple[float, float]
    customers_root: int
    tables_root: int


def root_probability(tables: np.ndarray, root: np.ndarray, s: Sweep, v: int) -> np.ndarray:
    strength = s.strengths[0]
    return (np.maximum(tables - DISCOUNTS[0] * root, 0) + (strength + DISCOUNTS[0] * s.tables_root) / (v + 1)) / (strength + s.customers_root)


def reseated_root(tables: np.ndarray, root: np.ndarray, s: Sweep, v: int, rng: np.random.Generator) -> np.ndarray:
    """The root tables of words after their tables have been seated in the root."""
    others = s.strengths[0] + DISCOUNTS[0] * np.maximum(s.tables_root - root, 0.0)
    return seated(tables, others, np.full(len(tables), 1 / (v + 1)), rng)


def replayed(bucket: int, pairs: tuple[np.ndarray, ...], sweeps: list[Sweep], known: Words, seed: int, last: bool, far: list[np.ndarray] | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A bucket's (tables of pairs, tables of rare words, their root tables) after the start and each sweep; ``last``: one sweep more than given; ``far``: tables of its rare contexts at each."""
    w, u, c = pairs
    rare = w < 0
    word = -1 - w[rare]
    n_rare = int(word.max(initial=-1)) + 1
    tables = np.minimum(c, 1).astype(np.int64)
    rare_tables = np.bincount(word, tables[rare], n_rare).astype(np.int64)
    states = [(tables, rare_tables, np.minimum(rare_tables, 1))]
    for k, s in enumerate(sweeps if last else sweeps[:-1]):
        rng = np.random.default_rng([seed, bucket, k])
        tables, rare_tables, rare_root = states[-1]
        root = np.empty(len(w))
        root[rare] = root_probability(rare_tables, rare_root, s, known.v)[word]
        root[~rare] = root_probability(s.common[w[~rare]], s.common_root[w[~rare]], s, known.v)
        on = np.concatenate([s.tables, far[k]]) if far else s.tables
        tables = seated(c.astype(np.int64), s.strengths[1] + DISCOUNTS[1] * np.maximum(on[u] - tables, 0), root, rng)
        rare_tables = np.bincount(word, tables[rare], n_rare).astype(np.int64)
        states.append((tables, rare_tables, reseated_root(rare_tables, rare_root, s, known.v, rng)))
    return states


def at_least(counts: np.ndarray, times: np.ndarray, most: int) -> np.ndarray:
    """How many of the restaurants have more than k, for k from 0 to most - 1."""
    n = np.bincount(np.minimum(counts, most).astype(np.int64), times, most + 1).astype(np.int64)
    return n.sum() - np.cumsum(n)[:-1]


def strength(current: float, discount: float, customers: np.ndarray, tables: np.ndarray, rng: np.random.Generator, far: tuple[dict[int, int], dict[int, int]] = ({}, {})) -> float:
    """A draw of a strength given its restaurants' customers and tables, with auxiliary variables and a Gamma(1, 1) prior.

    ``far``: how many further restaurants have so many customers (two at least), and
    how many have so many tables. The logarithm of a Beta(s + 1, c - 1) variable is
    less a sum of exponentials with the rates s + 1 to s + c - 1, so restaurants share
    one Gamma variable a rate; coin flips of one chance share a binomial.
    """
    open_ = customers > 1
    c, t = customers[open_], np.maximum(tables[open_], 1)
    c = np.concatenate([c, np.array(sorted(far[0]), np.int64)])
    t = np.concatenate([t, np.array(sorted(far[1]), np.int64)])
    c_times = np.concatenate([np.ones(int(open_.sum()), np.int64), np.array([far[0][k] for k in sorted(far[0])], np.int64)])
    t_times = np.concatenate([np.ones(int(open_.sum()), np.int64), np.array([far[1][k] for k in sorted(far[1])], np.int64)])
    if not len(c):
        return current
    rates = current + 1 + np.arange(TOGETHER)
    logs = (rng.standard_gamma(at_least(c - 1, c_times, TOGETHER)) / rates).sum()
    for k, n in zip(c[c - 1 > TOGETHER].tolist(), c_times[c - 1 > TOGETHER].tolist(), strict=True):
        logs -= np.log(rng.beta(current + 1 + TOGETHER, k - 1 - TOGETHER, n)).sum()
    r = current / discount
    flips, most = 0, int(t.max(initial=1))
    for first in range(0, most, 1 << 20):
        i = np.arange(max(first, 1), min(first + (1 << 20), most))
        n = at_least(np.maximum(t - first, 0), t_times, min(1 << 20, most - first))[i - first]
        flips += int(rng.binomial(n, r / (r + i)).sum())
    return float(np.clip(rng.gamma(1 + flips, 1 / (1 + logs)), 0.01, 1e6))


def shared(rows: DataFrame, k: int) -> DataFrame:
    """From rows (bucket, id, n, c, moves) a row a bucket: its rare contexts' sums over all buckets, in the order of their hashes.

    ``keys`` and ``times`` count contexts of two customers or more, each in the first
    of its buckets: 3 x customers, 3 x tables + 1 where they stay, + 2 where they move.
    """
    one = Window.partitionBy("id")
    sums = rows.select("bucket", "id", F.sum("n").over(one).alias("n"), F.sum("c").over(one).alias("c"), F.max("moves").over(one).alias("moves"), (F.min("bucket").over(one) == F.col("bucket")).alias("first"))

    def pack(rows: pa.Table) -> pa.Table:
        ids, n, c, moves, first = (rows.column(x).to_numpy() for x in ("id", "n", "c", "moves", "first"))
        order = np.argsort(ids.view(np.uint64))
        mine = first & (c > 1)
        keys, times = np.unique(np.concatenate([3 * c[mine], 3 * n[mine] + 1 + (moves[mine] > 0)]), return_counts=True)
        blob = packed(n[order]) if k else packed(n[order], c[order], moves[order] > 0)
        return pa.table({"bucket": rows.column("bucket").slice(0, 1), "sweep": pa.array([k], pa.int64()), "blob": pa.array([blob], pa.binary()), "keys": pa.array([keys], pa.list_(pa.int64())), "times": pa.array([times], pa.list_(pa.int64()))})

    return written(sums.groupBy("bucket").applyInArrow(pack, "bucket long, sweep long, blob binary, keys array<long>, times array<long>"), "lm-contexts")


def with_states(buckets: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """Buckets with ``states``: what is known of their rare contexts after the start and each sweep so far."""
    if not tables:
        return buckets.withColumn("states", F.lit(None).cast("array<struct<sweep:bigint,blob:binary>>"))
    rows = tables[0]
    for x in tables[1:]:
        rows = rows.unionByName(x)
    states = rows.groupBy("bucket").agg(F.collect_list(F.struct("sweep", "blob")).alias("states"))
    return buckets.join(states.hint("shuffle_hash"), "bucket", "left")


def sampled(buckets: DataFrame, known: Words, sweeps: int, seed: int) -> tuple[list[Sweep], np.ndarray, list[DataFrame]]:
    """The start and all sweeps, the customers of each common context, and the tables of rare contexts by bucket.

    A sweep is a pass over the pairs, a sum of at most two numbers a common context or
    common word from each task, and a sum by rare context.
    """
    size, common = known.contexts, len(known.hashes)
    done: list[Sweep] = []
    far_tables: list[DataFrame] = []
    far_customers: dict[int, int] = {}
    far_still: dict[int, int] = {}
    customers = np.zeros(size, np.int64)
    for k in range(sweeps + 1):
        before = list(done)

        def run(batches: Iterator[pa.RecordBatch], before: list[Sweep] = before) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 * size + common + 2, np.int64)  # tables of contexts, customers of contexts, tables of common words, root tables of rare words, all tables
            for b in batches:
                for bucket, blob, states in zip(b.column(0), b.column(1), b.column(2), strict=True):
                    (w, u, c), ids = pairs_of(blob.as_buffer(), known)
                    far, _, moves = far_of(states.as_py(), len(ids), len(before))
                    tables, _, root = replayed(bucket.as_py(), (w, u, c), before, known, seed, last=True, far=far)[-1]
                    by_context = np.bincount(u, tables, size + len(ids)).astype(np.int64)
                    total[:size] += by_context[:size]
                    n, c_far, may = by_context[size:], np.zeros(len(ids), np.int64), moves
                    if not before:
                        by_context = np.bincount(u, c, size + len(ids)).astype(np.int64)
                        total[size : 2 * size] += by_context[:size]
                        c_far, may, moves = by_context[size:], np.bincount(u, c > 1, size + len(ids))[size:] > 0, np.ones(len(ids), bool)
                    total[2 * size : -2] += np.bincount(w[w >= 0], tables[w >= 0], common).astype(np.int64)
                    total[-2:] += int(root.sum()), int(tables.sum())
                    yield batch(np.full(moves.sum(), bucket.as_py()), ids[moves].view(np.int64), n[moves], c_far[moves], may[moves])
            at = np.flatnonzero(total)
            none = np.zeros(len(at), np.int64)
            yield batch(none - 1, at, total[at], none, none)

        def batch(*columns: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns[:4]] + [pa.array(columns[4].astype(np.int32))], ["bucket", "id", "n", "c", "moves"])

        pairs = with_states(buckets.filter("bucket >= 0").select("bucket", "pairs"), far_tables).select("bucket", "pairs", "states")
        passed = written(pairs.mapInArrow(run, "bucket long, id long, n long, c long, moves int"), "lm-sweep")
        got = passed.filter("bucket < 0").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
        far_tables.append(shared(passed.filter("bucket >= 0"), k))
        seen = far_tables[-1].select(F.explode(F.arrays_zip("keys", "times")).alias("x")).groupBy(F.col("x.keys").alias("key")).agg(F.sum("x.times").alias("times")).collect()
        discard(passed)
        some = [{r.key // 3: r.times for r in seen if r.key % 3 == kind} for kind in range(3)]
        total = np.zeros(2 * size + common + 2, np.int64)
        total[got.column("id").to_numpy()] = got.column("n").to_numpy()
        if not before:
            customers = total[size : 2 * size]
            far_customers, far_still = some[0], some[1]
        rng = np.random.default_rng([seed, 2**32 + k])
        tables, on = total[:size], total[2 * size : -2]
        if before:
            root = reseated_root(on, before[-1].common_root, before[-1], known.v, rng)
        else:
            root = np.minimum(on, 1)
        n_root, t_root = int(total[-1]), int(root.sum() + total[-2])
        start = before[-1].strengths if before else (10.0, 10.0)
        both = {n: far_still.get(n, 0) + some[2].get(n, 0) for n in far_still | some[2]}
        strengths = (strength(start[0], DISCOUNTS[0], np.array([n_root]), np.array([t_root]), rng), strength(start[1], DISCOUNTS[1], customers, tables, rng, (far_customers, both)))
        done.append(Sweep(tables, on, root, strengths, n_root, t_root))
    return done, customers, far_tables


def scored(docs: DataFrame, sweeps: int = 3, burn_in: int = 1, seed: int = 1) -> DataFrame:
    """A row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    All documents are scored; those whose crc32(doc_id as text) mod 10 is not 0
    train (a null id counts as '' and is held out). Null text counts as empty: its
    only token is the end. Partial sums travel in single precision, so scores of runs
    that cut the tables differently agree to about 7 digits. score sums log10 of the predictive probability averaged
    over the sweeps after ``burn_in``; 10 ** (-score / n_tokens) is the perplexity.
    base_score is the smoothed unigram score. Rows with equal ids stay rows; equal
    texts of equal ids get equal scores; an empty table gives none; without training
    documents every probability is 1.
    """
    rows = docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = counted(rows)
    buckets = dealt(rows, known)
    done, customers, far_tables = sampled(buckets, known, sweeps, seed)
    used = range(burn_in + 1, sweeps + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        first = None
        for b in batches:
            for bucket, blob, where, given in zip(b.column(0), b.column(1), b.column(2), b.column(3), strict=True):
                first = bucket.as_py() if first is None else first
                pairs, ids = pairs_of(blob.as_buffer(), known)
                w, u, c = pairs
                far, far_customers, _ = far_of(given.as_py(), len(ids), len(done))
                all_customers = np.concatenate([customers, far_customers])
                chunk, cuts, spot, doc = unpacked(where.as_buffer())
                spot = np.cumsum(spot, dtype=np.int32)
                states = replayed(bucket.as_py(), pairs, done, known, seed, last=False, far=far)
                rare = w < 0
                word = -1 - w[rare]
                p = np.zeros(len(w))
                for k in used:
                    tables, rare_tables, rare_root = states[k]
                    s = done[k]
                    on = np.concatenate([s.tables, far[k]]) if far else s.tables
                    root = np.empty(len(w))
                    root[rare] = root_probability(rare_tables, rare_root, s, known.v)[word]
                    root[~rare] = root_probability(s.common[w[~rare]], s.common_root[w[~rare]], s, known.v)
                    p += (np.maximum(c - DISCOUNTS[1] * tables, 0) + (s.strengths[1] + DISCOUNTS[1] * on[u]) * root) / (s.strengths[1] + all_customers[u])
                del states
                logs = np.log10(p / len(used))
                count = np.bincount(word, c[rare], int(word.max(initial=-1)) + 1)[word]
                base, seen = np.zeros(len(w)), np.zeros(len(w))
                base[rare], seen[rare] = np.log10(count + 0.1), count > 0
                for i, name in enumerate(chunk.tolist()):
                    at, d = spot[cuts[i] : cuts[i + 1]], doc[cuts[i] : cuts[i + 1]]
                    sums = np.stack([np.bincount(d, x[at]) for x in (logs, base, seen)])
                    if name in held and held[name].shape[1] >= sums.shape[1]:
                        held[name][:, : sums.shape[1]] += sums
                    else:
                        if name in held:
                            sums[:, : held[name].shape[1]] += held[name]
                        held[name] = sums
                if sum(x.shape[1] for x in held.values()) > HELD_DOCS:
                    yield passed_on(first, held)
                    held, first = {}, None
        if held:
            yield passed_on(first, held)

    def passed_on(bucket: int, held: dict[int, np.ndarray]) -> pa.RecordBatch:
        """Partial sums of the documents that have any, in single precision."""
        blobs = []
        for sums in held.values():
            present = np.flatnonzero((sums != 0).any(0))
            blobs.append(packed(np.diff(present, prepend=0).astype(np.uint16), sums[0, present].astype("f4"), sums[1, present].astype("f4"), sums[2, present].astype(np.uint32)))
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([bucket] * len(held), pa.int64()), pa.array(blobs, pa.binary())], ["chunk", "bucket", "blob"])

    def assemble(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("bucket")
        ids, lengths, train, total = [], np.zeros(0, np.int64), np.zeros(0, bool), np.zeros((3, 0))
        for bucket, blob in zip(rows.column("bucket"), rows.column("blob"), strict=True):
            if bucket.as_py() < 0:
                ids, lengths, train, base, seen = pickle.loads(blob.as_buffer())
                total = np.stack([np.zeros(len(ids)), base, seen])
            else:
                steps, *sums = unpacked(blob.as_buffer())
                total[:, np.cumsum(steps, dtype=np.int64)] += sums
        base = total[1] - lengths * math.log10(known.n + 0.1 * (known.v + 1))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(~train), "n_tokens": pa.array(lengths, pa.int64()), "n_known": pa.array(total[2].round().astype(np.int64)), "train_tokens": pa.array([known.n] * len(ids), pa.int64()), "base_score": pa.array(base), "score": pa.array(total[0])})

    placed = with_states(buckets.filter("bucket >= 0").select("bucket", "pairs", "places"), far_tables)
    scores = placed.select("bucket", "pairs", "places", "states").mapInArrow(score, "chunk long, bucket long, blob binary")
    heads = buckets.filter("bucket < 0").select("chunk", "bucket", F.col("places").alias("blob"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return scores.unionByName(heads).groupBy("chunk").applyInArrow(assemble, schema)
