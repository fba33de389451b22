"""N-gram Jaccard join: the universe in segments by size band, exact by the pigeonhole principle.

Two sets of sizes s <= l with Jaccard similarity of at least d differ in at most
H = floor((1 - d) / (1 + d) * (s + l)) elements. Shingle hashes fall into
m segments of the universe, one more than H can be in the set's size band. A
band's bounds are a factor 1 / d apart, so a set indexes its segments under its
own band and, where a smaller partner can lie there, under the one below.

Each set allots its segments the values 0 (not looked up), 1 (looked up whole) or
2 (looked up with one-deletion neighbours), by cost:

* A pair that agrees in e segments only differs in the m - e others, at least once
  in each. With slack = m - 1 - H that needs e > slack, and then at most
  e - 1 - slack of those others differ by two elements or more.
* So a set may give the value 0 to ``slack`` segments for nothing, and to e > slack
  if its first 2 e - slack segments, in the order of the universe, get the value 2:
  whatever its partner has chosen, their common run of such segments has one outside
  the agreed ones that differs by exactly one element. That holds up to
  e = (m + slack) / 2.
* A segment without elements costs most, as every set has some: it is the first to
  get 0. Others cost what is measured, see ``allotted``. The cost belongs to a
  segment's content, so both of a pair that agrees there know it alike; a content
  is looked up if either set does not drop it.

What is returned are components, not pairs: pairs inside a component are not all
verified, so verified_links is a lower bound of a class's links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from math import floor, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from flockline.llm.common import arrow_rows, discard, shuffles_removed, written

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: A candidate pair costs about as much as so many signatures: it travels four times with 32 bytes and more, a signature once with 16.
PAIR_COST = 8.0
#: Marks of the classes whose sets are asked for: bits a class, and the most bits (32 MB). Classes without a pair may share a mark; a join drops them later.
MARKS_EACH, MARKS_MOST = 16, 1 << 28

#: Classes of a signature that meet in one task with as many others.
BLOCK = 4096
#: Rows of places with the same least component that go to one task, and pairs that a task holds to find repeats (8 MB).
SHARE, HELD = 1 << 15, 1 << 18
#: Rows that go to Python at once.
ROWS = 1024
#: Parts of the signatures' places that are shuffled one after another.
SLICES = 4


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """A text's set of word shingles as sorted 64-bit hashes, and a 16-byte digest of its words."""

    def __init__(self, n: int) -> None:
        self.n, self.cache = n, {}

    def words(self, text: str) -> tuple[np.ndarray, bytes]:
        """The hashes of a text's words, and their digest; empty without words."""
        found = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
        cache = self.cache
        if len(cache) > 500_000:
            cache.clear()
        ids = list(map(cache.get, found))
        if None in ids:
            for i, h in enumerate(ids):
                if h is None:
                    ids[i] = cache[found[i]] = xxhash.xxh3_64_intdigest(found[i])
        h = np.array(ids, np.uint64)
        return h, xxhash.xxh3_128_digest(h.tobytes()) if ids else b""

    def shingles(self, h: np.ndarray) -> np.ndarray:
        if not len(h):
            return h
        n = min(self.n, len(h))
        with np.errstate(over="ignore"):
            out = np.full(len(h) - n + 1, len(h) if len(h) < self.n else self.n, np.uint64)
            for k in range(n):
                out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
        out.sort()
        return out[np.append(True, out[1:] != out[:-1])]

    def __call__(self, text: str) -> tuple[np.ndarray, bytes]:
        h, digest = self.words(text)
        return self.shingles(h), digest


class Bands:
    """Size bands for a similarity of percent / 100, in whole numbers."""

    def __init__(self, percent: int) -> None:
        self.percent = percent

    @lru_cache(maxsize=4096)  # noqa: B019
    def low(self, band: int) -> int:
        """The least size in a band."""
        size = 1
        for _ in range(band):
            size = size * 100 // self.percent + 1
        return size

    @lru_cache(maxsize=65536)  # noqa: B019
    def of(self, size: int) -> int:
        band = max(0, floor(log(max(size, 1)) / log(100 / self.percent)) // 4)
        while self.low(band + 1) <= size:
            band += 1
        while self.low(band) > size:
            band -= 1
        return band

    @lru_cache(maxsize=4096)  # noqa: B019
    def segments(self, band: int) -> int:
        """More than the elements in which a pair can differ whose smaller set lies in the band."""
        small = self.low(band + 1) - 1
        large = small * 100 // self.percent
        return floor((100 - self.percent) * (small + large) / (100 + self.percent)) + 1

    def used(self, size: int) -> list[int]:
        """The bands in which a set of this size can have a smaller or equal partner, and its own."""
        return list(range(self.of(-(-size * self.percent // 100)), self.of(size) + 1))

    def slack(self, band: int, size: int) -> int:
        """The segments of a band beyond those that a pair with a set of this size needs."""
        other = min(size, self.low(band + 1) - 1) if size >= self.low(band + 1) else size * 100 // self.percent
        return self.segments(band) - 1 - (100 - self.percent) * (size + other) // (100 + self.percent)


def parts(s: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a sorted set: where each of the m segments begins (and the last ends), and the sum of each one's mixed elements."""
    segment = (s >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
    starts = np.searchsorted(segment, np.arange(m + 1, dtype=np.uint64))
    with np.errstate(over="ignore"):
        upto = np.zeros(len(s) + 1, np.uint64)
        np.cumsum(spread(s), out=upto[1:])
        return starts, upto[starts[1:]] - upto[starts[:-1]]


def spread(s: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(s + np.uint64(0x632BE59BD9B4E019))


def parity(s: np.ndarray) -> bytes:
    """512 bits, each the parity of the elements that fall to it: two sets differ in at least as many elements as their bits do."""
    return np.packbits(np.bincount((s & np.uint64(511)).astype(np.int64), minlength=512).astype(np.uint8) & 1).tobytes()


#: Kinds of signatures, in their two lowest bits: a segment that is looked up whole, one with neighbours, and one without an element. A pair meets in two of kind WHOLE, or in one FULL and one LESS.
WHOLE, FULL, LESS = 0, 1, 2


def signature(band: int, numbers: np.ndarray, sums: np.ndarray, kind: int = WHOLE) -> np.ndarray:
    """A 64-bit name of a segment's content: band, segment number and kind are part of it; FULL and LESS of one content differ in the two lowest bits only."""
    with np.errstate(over="ignore"):
        name = mixed(sums + mixed(numbers.astype(np.uint64) + np.uint64((2 * band + 1 + (kind > 0)) << 40)))
    return (name >> np.uint64(2) << np.uint64(2) | np.uint64(kind)).view(np.int64)


def place(sig: Column) -> Column:
    """Where signatures meet."""
    return sig.bitwiseAND(F.lit(-4))


def kind(sig: Column) -> Column:
    return sig.bitwiseAND(F.lit(3))


def neighbours(band: int, s: np.ndarray, m: int, first: int) -> list[np.ndarray]:
    """Signatures of the first so many of m segments: of each one itself and of itself without each one of its elements."""
    starts, sums = parts(s, m)
    numbers = np.repeat(np.arange(first), np.diff(starts)[:first])
    with np.errstate(over="ignore"):
        less = sums[numbers] - spread(s[: starts[first]])
    return [signature(band, np.arange(first), sums[:first], FULL), signature(band, numbers, less, LESS)]


def indexed(s: np.ndarray, bands: Bands) -> np.ndarray:
    """All signatures that a set is looked up by before costs are measured: empty segments get the value 0 as far as that is exact."""
    out = []
    for band in bands.used(len(s)):
        m = bands.segments(band)
        starts, sums = parts(s, m)
        full = np.diff(starts) > 0
        slack, e = bands.slack(band, len(s)), int(m - full.sum())
        out.append(signature(band, np.arange(m), sums)[full if 2 * e <= m + slack else slice(None)])
        if e > slack:
            out += neighbours(band, s, m, min(m, 2 * e - slack))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def settled(links: DataFrame, rounds: int = 40) -> DataFrame:
    """a, m: of each end of ``links`` (a, b) the least node reachable, by alternating large and small stars; a written table.

    Every round writes each node's least and largest neighbour, and ends where no
    node with a smaller neighbour has another: all trees are stars then. Stars halve
    the depth of trees, so rounds grow with the logarithm of the longest chain. Every
    step groups by node and takes a minimum before it joins; no component meets in
    one task. Links may repeat; a round drops repeats before it joins.
    """
    links = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
    for _ in range(rounds):
        back = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
        ends = written(links.union(back).groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.max("b").alias("x")), "ends")
        if ends.filter("m < a and x > m").isEmpty():
            discard(links)
            return ends
        large = back.join(ends, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = written(large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(low.select("a", F.col("m").alias("b"))), "links")
        discard(links, ends)
        links = small
    raise RuntimeError("the components did not settle")


def components(nodes: DataFrame, links: DataFrame, node: str, name: str = "component") -> DataFrame:
    """``node`` and ``name``: the least node reachable by ``links`` (a, b)."""
    found = settled(links).select(F.col("a").alias("__a"), F.col("m").alias("__m"))
    return nodes.join(found, F.col(node) == F.col("__a"), "left").select(node, F.coalesce("__m", node).alias(name))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes: those whose whole sets of shingles are similar enough.

    Sizes and parities, 72 bytes a class, rule most others out before sets travel.
    """
    for end in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("class").alias(end), F.col("size").alias(f"n{end}"), F.col("parity").alias(f"p{end}")), end)

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 4096):
            na, nb = (b.column(k).to_numpy() for k in ("na", "nb"))
            pa_, pb = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, 64) for k in ("pa", "pb"))
            apart = np.bitwise_count(pa_ ^ pb).sum(1)
            fit = (apart <= (100 - percent) * (na + nb) // (100 + percent)) & (np.minimum(na, nb) * 100 >= percent * np.maximum(na, nb))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(fit))

    pairs = pairs.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(possible, "a binary, b binary")
    with_a = pairs.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("sa")), "a")
    both = with_a.join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 256):
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a binary, b binary")


def contracted(placed: DataFrame, links: DataFrame) -> DataFrame:
    """Components (class, component) after further links (a, b): only the components that these touch are joined anew."""
    ends = links
    for end in ("a", "b"):
        ends = ends.join(placed.select(F.col("class").alias(end), F.col("component").alias(f"c{end}")), end)
    moved = settled(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    found = moved.select(F.col("a").alias("component"), F.col("m").alias("least"))
    out = written(placed.join(found, "component", "left").select("class", F.coalesce("least", "component").alias("component")), "join-components")
    discard(moved)
    return out


def between(members: DataFrame, placed: DataFrame) -> DataFrame:
    """Members (place, sig, class) of places that still join different components, with their component and the place's cost.

    The cost is how many classes of other components its classes meet there, on average.
    """
    found = members.join(placed, "class")
    each = found.groupBy("place", "component").agg(F.count(F.lit(1)).cast("double").alias("n"))
    several = each.groupBy("place").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    return written(found.join(several.select("place", ((F.col("n") * F.col("n") - F.col("own")) / F.col("n")).alias("cost")), "place"), "join-between")


def stars(members: DataFrame) -> DataFrame:
    """Pairs (a, b): the least class of each component in a place with the least class there."""
    heads = members.groupBy("place", "component").agg(F.min("class").alias("b"))
    first = heads.groupBy("place").agg(F.min("b").alias("a"))
    return heads.join(first, "place").filter("a < b").select("a", "b").distinct()


def allotted(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """sig, class, active: what each set is looked up by, once costs are measured; members: sig, class, component, cost.

    Beyond the free ones, a segment gets the value 0 where its cost in candidates is
    more than that of the two segments that get the value 2 instead, or as far as the
    theorem at the top allows. Rows that are not active are met by active ones only.
    """
    bands = Bands(percent)
    held = members.groupBy("class").agg(F.collect_list(F.struct("sig", "cost")).alias("held"))
    rows = sets.join(held, "class").select("class", "shingles", F.col("held.sig").alias("sigs"), F.col("held.cost").alias("costs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 32):
            names, sigs, active = [], [], []
            for name, blob, known, costs in zip(*b.columns, strict=True):
                s, known, costs = np.frombuffer(blob.as_buffer(), "<u8"), np.array(known.as_py(), np.int64), np.array(costs.as_py())
                order = np.argsort(known)
                known, costs, rest = known[order], costs[order], np.ones(len(order), bool)
                for band in bands.used(len(s)):
                    m = bands.segments(band)
                    starts, sums = parts(s, m)
                    at = np.searchsorted(known, own := signature(band, np.arange(m), sums))
                    at[at == len(known)] = 0
                    here = np.flatnonzero(known[at] == own)
                    slack, empty = bands.slack(band, len(s)), int((np.diff(starts) == 0).sum())
                    full = here[np.diff(starts)[here] > 0]
                    cost = costs[at[full]]
                    dear = int((cost >= 2 * (bands.low(band) / m + 1) / PAIR_COST).sum())
                    drop = max(0, slack - empty, min(dear, (m + slack) // 2 - empty))
                    gone = full[np.lexsort((own[full], -cost))[:drop]]
                    e = empty + len(gone)
                    rest[at[here]] = False
                    found = [own[here], *(neighbours(band, s, m, min(m, 2 * e - slack)) if len(gone) and e > slack else [])]
                    sigs += found
                    n = sum(map(len, found))
                    active.append(np.append(~np.isin(here, gone), np.ones(n - len(here), bool)))
                    names += [name.as_py()] * n
                sigs.append(known[rest])  # neighbours from the index
                active.append(np.ones(int(rest.sum()), bool))
                names += [name.as_py()] * int(rest.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int64)), pa.array(names, pa.binary()), pa.array(np.concatenate(active) if active else np.zeros(0, bool))], ["sig", "class", "active"])

    return rows.mapInArrow(run, "sig long, class binary, active boolean").groupBy("sig", "class").agg(F.max("active").alias("active"))


def two_words(column: pa.ChunkedArray) -> np.ndarray:
    """16-byte names as rows of two numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 2)


def as_names(words: np.ndarray) -> pa.Array:
    """Rows of two numbers as 16-byte names."""
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(np.arange(0, 16 * len(words) + 1, 16, dtype=np.int32)), pa.py_buffer(words.tobytes())])


def without_repeats(pairs: np.ndarray) -> np.ndarray:
    """Pairs, as rows of four numbers, once each: one number brings equal rows together, and whole rows are compared."""
    with np.errstate(over="ignore"):
        at = np.zeros(len(pairs), np.uint64)
        for column in pairs.T:
            at = mixed(at + column)
    pairs = pairs[np.argsort(at)]
    return pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(1))[: len(pairs)]]


def cross_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs a < b of classes of different components that meet in a signature that at least one of them is looked up by, as far as sizes and parities allow them; members: sig, class, component, active.

    The classes of a place are compared where they are, so that only pairs that pass
    become rows. A place of many classes is dealt to blocks of about BLOCK, and each
    two blocks meet in a task of their own. Two sets that are almost similar meet in
    most of their segments: places go to tasks by their least component, which such
    places mostly share, and a task makes each pair one row. Components that are the
    least in places of more than SHARE rows are dealt to so many tasks more.
    """
    members = members.select(place(F.col("sig")).alias("place"), kind(F.col("sig")).alias("kind"), "class", "component", "active")
    useful = members.groupBy("place").agg(F.max("active").alias("any"), F.min("component").alias("x"), F.max("component").alias("y"), F.bit_or("kind").alias("kinds"), F.count(F.lit(1)).alias("n"))
    places = written(useful.filter(f"any and x < y and kinds in ({WHOLE}, {FULL | LESS})").select("place", "x", "n"), "join-places")
    # At most a row for SHARE rows of members.
    large = places.groupBy("x").agg(F.sum("n").alias("rows")).filter(F.col("rows") > SHARE).select("x", F.ceil(F.col("rows") / SHARE).alias("shares"))
    useful = places.join(F.broadcast(large), "x", "left")
    deal = F.xxhash64("x", F.pmod(F.xxhash64("place"), F.coalesce("shares", F.lit(1))))
    # Written, so that the shuffles that found these rows are gone before sizes and parities travel with them.
    meeting = written(members.join(useful.select("place", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), deal.alias("deal")), "place"), "join-useful")
    rows = meeting.join(sets.select("class", "size", "parity"), "class")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("deal", "place", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "kind", "active", "class", "component", "size", "parity")

    def compared(t: pa.Table) -> Iterator[np.ndarray]:
        at, p, q, own, kinds, active, size = (t.column(c).to_numpy() for c in ("place", "p", "q", "own", "kind", "active", "size"))
        name, component, bits = two_words(t.column("class")), two_words(t.column("component")), np.frombuffer(b"".join(t.column("parity").to_pylist()), np.uint64).reshape(-1, 8)
        new = np.append(True, (at[1:] != at[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]))
        starts = np.append(np.flatnonzero(new), len(at))
        end = starts[np.cumsum(new)]
        i, k = np.arange(len(at)), 0
        while True:
            k += 1
            i = i[i + k < end[i]]
            if not len(i):
                break
            j = i + k
            fit = (active[i] | active[j]) & ((kinds[i] ^ kinds[j]) == np.where(kinds[i] == WHOLE, 0, FULL ^ LESS)) & ((own[i] != own[j]) | (p[i] == q[i]))
            x, y = i[fit], j[fit]
            fit = (component[x] != component[y]).any(1) & (np.minimum(size[x], size[y]) * 100 >= percent * np.maximum(size[x], size[y]))
            x, y = x[fit], y[fit]
            fit = np.bitwise_count(bits[x] ^ bits[y]).sum(1) <= (100 - percent) * (size[x] + size[y]) // (100 + percent)
            x, y = x[fit], y[fit]
            back = (name[x, 0] > name[y, 0]) | (name[x, 0] == name[y, 0]) & (name[x, 1] > name[y, 1])
            yield np.concatenate([name[np.where(back, y, x)], name[np.where(back, x, y)]], 1)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            last = np.logical_and.reduce([t.column(c).to_numpy() == t.column(c)[-1].as_py() for c in ("place", "p", "q")]) if t.num_rows else np.zeros(0, bool)
            cut = int(np.argmax(last)) if t.num_rows else 0
            if cut:
                yield from compared(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield from compared(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [np.zeros((0, 4), np.uint64)], 0
        for pairs in found(batches):
            if not len(pairs):
                continue
            held.append(pairs)
            n += len(pairs) + 4  # an array weighs something itself
            if n > HELD:
                held = [without_repeats(np.concatenate(held))]
                n = len(held[0])
                if n > HELD // 2:
                    yield pa.RecordBatch.from_arrays([as_names(held[0][:, :2]), as_names(held[0][:, 2:])], ["a", "b"])
                    held, n = [held[0][:0]], 0
        last = without_repeats(np.concatenate(held))
        yield pa.RecordBatch.from_arrays([as_names(last[:, :2]), as_names(last[:, 2:])], ["a", "b"])

    pairs = rows.repartition("deal", "p", "q").sortWithinPartitions("deal", "place", "p", "q").mapInArrow(run, "a binary, b binary")
    out = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "join-crossed")
    discard(meeting, places)
    return out


def meeting(signed: DataFrame) -> DataFrame:
    """Distinct signatures (place, kind, name) of places in which two names meet.

    One shuffle by place brings copies from different tasks together, counts and joins."""
    once = signed.repartition("place").distinct()
    real = once.groupBy("place").agg(F.min("name").alias("x"), F.max("name").alias("y"), F.bit_or("kind").alias("kinds"))
    real = real.filter(f"x < y and kinds in ({WHOLE}, {FULL | LESS})").select("place")
    return once.join(real.hint("shuffle_hash"), "place", "left_semi")


def joined(docs: DataFrame, percent: int = 90, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``linked``, with few rows at once between Spark and Python: a row may be a long text or its whole set."""
    with arrow_rows(docs.sparkSession, ROWS):
        return linked(docs, percent, shingle, key, text)


def linked(docs: DataFrame, percent: int = 90, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document: ``key``, n_shingles, component_id, and verified_links: its class's verified links to others.

    Two documents link when 100 * intersection >= percent * union of their sets of
    distinct ``shingle``-word shingles (A to Z lower-cased); component_id is the
    least key reachable by links, itself included. Equal word sequences form a
    class, whose least key stands for it; only classes are joined.

    1. One pass over the texts gives sizes, digests and signatures, each class's once
       a task. They meet by slices of their places, so that the disk holds the shuffle
       of one slice at a time; those of two classes name the classes that a second
       pass writes the sets of.
    2. Each class is verified on the whole sets with the least one that it shares a
       signature with; that gives components. Then, where a signature still joins
       different components, the least class of each with the least of all. A group of
       near copies is mostly one component after that, without all its pairs.
    3. Where a signature still joins different components, values are allotted by
       measured cost, and all pairs across components that these leave are verified:
       no link is lost.

    Texts without words, or null, are empty, link with nothing and are their own
    component; fewer words than a shingle are one shingle. A row with a null key
    links by its text; its component_id is null if all reachable keys are. Rows
    with equal keys stay rows. An empty table gives none. ``key`` may be any type that
    has an order. Hashes of 64 bits stand for shingles: two of a pair's n shingles
    collide with probability n**2 / 2**65.
    """
    spark = docs.sparkSession
    bands = Bands(percent)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        done: set[bytes] = set()
        for b in sliced(batches, 512):
            digests, sizes, sigs = [], [], []
            for t in b.column(1):
                s, digest = shingler(t.as_py() or "")
                digests.append(digest)
                sizes.append(len(s))
                sigs.append(indexed(s, bands) if len(s) and digest not in done else np.zeros(0, np.int64))
                done.add(digest)
            if len(done) > 1_000_000:
                done.clear()
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sigs)]).astype(np.int32), np.concatenate(sigs) if sigs else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), lists], ["key", "class", "n_shingles", "sigs"])

    schema = StructType([rows.schema["key"], StructField("class", BinaryType()), StructField("n_shingles", LongType()), StructField("sigs", ArrayType(LongType()))])
    signatures = written(rows.mapInArrow(sign, schema), "join-signed")
    measured = written(signatures.drop("sigs"), "join-measured")
    # A class goes by the first 60 bits of its digest here; classes that share them share candidates, no more.
    name = F.conv(F.substring(F.hex("class"), 1, 15), 16, 10).cast("long")
    classes = written(measured.filter("n_shingles > 0").groupBy("class").agg(F.min("key").alias("first")).withColumn("name", name), "join-classes")
    sig = F.col("sig")
    signed = signatures.select(F.explode("sigs").alias("sig"), name.alias("name")).select(place(sig).alias("place"), kind(sig).cast("byte").alias("kind"), "name")
    met = [written(meeting(signed.filter(F.pmod(F.shiftright("place", 2), F.lit(SLICES)) == k)), "join-met") for k in range(SLICES)]
    discard(signatures)
    members = written(reduce(DataFrame.union, met).join(classes, "name").select("place", F.col("place").bitwiseOR(F.col("kind").cast("long")).alias("sig"), "class"), "join-members")
    discard(*met)
    wanted = written(members.select("class").distinct(), "join-wanted")
    size = 1 << int(np.clip(wanted.count() * MARKS_EACH, 1 << 10, MARKS_MOST)).bit_length() - 1
    with shuffles_removed(spark):
        spots = wanted.select((name % size).alias("m")).distinct().toArrow().column("m").to_numpy()
    marks = np.zeros(size, bool)
    marks[spots] = True
    marks = np.packbits(marks)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        done: set[bytes] = set()
        for b in sliced(batches, 256):
            names, sets = [], []
            for t in b.column(1):
                h, digest = shingler.words(t.as_py() or "")
                at = (int.from_bytes(digest[:8], "big") >> 4) % size
                if len(h) and marks[at >> 3] >> (7 - at & 7) & 1 and digest not in done:
                    done.add(digest)
                    names.append(digest)
                    sets.append(shingler.shingles(h).astype("<u8"))
            if len(done) > 1_000_000:
                done.clear()
            columns = [pa.array(names, pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array([parity(x) for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["class", "shingles", "size", "parity"])

    sets = written(rows.mapInArrow(pack, "class binary, shingles binary, size long, parity binary").join(wanted, "class", "left_semi").dropDuplicates(["class"]), "join-sets")
    def across(found: DataFrame) -> DataFrame:
        """The pairs that are left, of what each set is looked up by."""
        looked = written(allotted(found, sets, percent), "join-allotted")
        discard(found)
        pairs = cross_pairs(looked.join(placed, "class"), sets, percent)
        discard(looked)
        return pairs

    least = members.groupBy("place").agg(F.min("class").alias("a"))
    tried = written(members.join(least, "place").filter("a < class").groupBy(F.col("class").alias("b")).agg(F.min("a").alias("a")).select("a", "b"), "join-tried")
    links = written(verified(tried, sets, percent), "join-links")
    placed = written(components(wanted, links, "class"), "join-components")
    open_ = between(members, placed)
    discard(members, wanted)
    for step in (stars, across):
        if open_.isEmpty():
            break
        pairs = written(step(open_).join(tried, ["a", "b"], "left_anti"), "join-pairs")
        new = written(verified(pairs, sets, percent), "join-links")
        tried = tried.union(pairs)
        if not new.isEmpty():
            links = links.union(new)
            before, placed = placed, contracted(placed, new)
            discard(before)
            if step is stars:
                before, open_ = open_, between(open_.select("place", "sig", "class"), placed)
                discard(before)
    discard(sets)
    least = placed.join(classes, "class").groupBy("component").agg(F.min("first").alias("component_id"))
    ends = links.select(F.col("a").alias("class")).union(links.select(F.col("b").alias("class"))).groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
    by_class = classes.join(placed.join(least, "component").select("class", "component_id"), "class", "left").join(ends, "class", "left")
    by_class = by_class.select(F.col("class").alias("__class"), F.coalesce("component_id", "first").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = measured.select("key", "class", "n_shingles").join(by_class, F.col("class") == F.col("__class"), "left")
    return out.select(F.col("key").alias(key), "n_shingles", F.when(F.col("__class").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("verified_links"))
