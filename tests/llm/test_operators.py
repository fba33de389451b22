"""The training-data operators against brute force, on rows that are hard: nulls, blanks, repeats, ties, long texts, clashing columns."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from flockline.llm import common, density_html, mcd, mixing, ordinal, pitman_yor, rendezvous, scaled_sketch, segjoin, urlglob, wordbpe
from flockline.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, shard int, size long, class string, chunk long"


def corpus():
    draw = random.Random(3)
    names = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(160)]
    body = lambda n: " ".join(draw.choice(names) for _ in range(n))
    texts = [None, "", " \t\n ", "one", "Two words", "e\u0301 ÅNGSTRÖM İstanbul ΣΑΣ <|endoftext|> don't we'll 12³ \u00a0x", "a\nb\na\n\nb", "🙂 " * 5]
    texts += [body(n) for n in (3, 4, 5, 40, 60, 80, 120, 300)]
    base = body(200)
    words = base.split()
    texts += [base, base, base.upper(), " ".join(words[:190] + ["new"] * 2 + words[190:]), " ".join(words[:100])]
    texts += [f"{base} {i}" for i in range(12)] + [body(120) for _ in range(30)] + ["x " * 3000 + body(50), body(6000)]
    rows = [(None if i == 7 else i * 3 - 5, t, None if i % 11 == 3 else "en" if i % 3 else "de", None if i % 7 == 2 else f"s{i % 3}", len(t or ""), True, 5, 1, "c", 2) for i, t in enumerate(texts)]
    return [*rows, rows[16], rows[16]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def many(rows):
    return Counter(map(tuple, rows))


# --- 1 -----------------------------------------------------------------------------------------


def base_statistics(text):
    text = text or ""
    w, places, seen, repeated = WORD.findall(text), {}, set(), 0
    for k in range(len(w) - 2):
        places.setdefault(tuple(w[k : k + 3]), []).append(k)
    covered = {p + j for v in places.values() if len(v) > 1 for p in v for j in range(3)}
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_base_statistics(docs, empty):
    found = mcd.judged(docs, least=20).collect()
    assert many((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found) == many((r[0], *base_statistics(r[1])) for r in corpus())
    assert all(not r.kept for r in found if r.base_failed)
    assert mcd.judged(empty).count() == 0


def test_estimates_against_numpy(spark):
    draw = np.random.default_rng(1)
    x = (draw.normal([1.6, 0.1, 0.2, 0.1], [0.05, 0.03, 0.05, 0.05], (400, 4)).clip(0) * mcd.UNIT).round().astype(int)
    x[:40] += np.array([0, 3000, 2500, 2500])
    rows = spark.createDataFrame([("g", *map(int, r)) for r in x], "g string, " + ", ".join(f"{c} long" for c in mcd.X))
    got = mcd.estimates(rows, "g", 0.75, 5).first().asDict()
    clean = x[40:] / mcd.UNIT
    assert np.allclose([got[f"__m{i}"] for i in range(4)], clean.mean(0), atol=0.02)
    factor = np.zeros((4, 4))
    for i, j in mcd.PAIRS:
        factor[i, j] = got[f"__i{i}{j}"]
    distance = (((x / mcd.UNIT - [got[f"__m{i}"] for i in range(4)]) @ factor.T) ** 2).sum(1)
    cutoff = mcd.chi2_quantile(0.999999, 4)
    assert (distance[:40] > cutoff).all() and (distance[40:] <= cutoff).all()


def test_cholesky(spark):
    a = np.array([[4, 1, 0.5, 0.2], [1, 3, 0.3, 0.1], [0.5, 0.3, 2, 0.4], [0.2, 0.1, 0.4, 1]])
    got = mcd.factored(spark.createDataFrame([tuple(float(a[i, j]) for i, j in mcd.PAIRS)], ", ".join(f"__c{i}{j} double" for i, j in mcd.PAIRS))).first()
    want = np.linalg.inv(np.linalg.cholesky(a))
    assert all(got[f"__i{i}{j}"] == pytest.approx(want[i, j]) for i, j in mcd.PAIRS) and got["__logdet"] == pytest.approx(np.linalg.slogdet(a)[1])
    assert mcd.chi2_quantile(0.95, 4) == pytest.approx(9.487729, abs=1e-5)


def test_symbols_are_outliers(spark):
    draw = random.Random(2)
    body = lambda mark: " ".join("".join(draw.choice("abcde") for _ in range(draw.randint(2, 7))) + mark for _ in range(90))
    rows = [(i, body("%%%" if i < 8 else ""), "en", "s") for i in range(120)]
    found = {r.doc_id: r.kept for r in mcd.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), least=50).collect()}
    assert found == {i: i >= 8 for i in range(120)}


# --- 2 -----------------------------------------------------------------------------------------


def key52(*parts):
    return int(hashlib.md5("/".join(map(str, parts)).encode()).hexdigest()[:13], 16)


def test_shards(docs, empty):
    found = rendezvous.shards(docs, [1.0] * 8).collect()
    name = lambda i: "null" if i is None else i
    best = lambda i, n: min(range(n), key=lambda s: (-key52(name(i), s, "shard"), s))
    assert many((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in found) == many((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()), "key", best(r[0], 8), best(r[0], 9)) for r in corpus())
    for s in range(8):
        slots = sorted(r.slot for r in found if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 8) for r in found)
    assert rendezvous.shards(empty, [1.0, 2.0]).count() == 0


def test_weighted_shards(spark):
    df = spark.range(20000).select(rendezvous.shard_of(F.col("id"), [1.0, 3.0]).alias("a"), rendezvous.shard_of(F.col("id"), [1.0, 3.0, 2.0]).alias("b"))
    assert df.where("a = 1").count() / 20000 == pytest.approx(0.75, abs=0.02)
    assert df.where("a <> b and b <> 2").count() == 0
    with pytest.raises(ValueError):
        rendezvous.shard_of(F.col("id"), [1.0, 0.0])


# --- 3 -----------------------------------------------------------------------------------------


def test_bpe(spark, docs, empty, monkeypatch):
    t = wordbpe.tokenizer(vocabulary())
    found = wordbpe.digests(docs, vocabulary()).collect()

    def want(text):
        ids = t.encode(text or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert many((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == many((r[0], *want(r[1])) for r in corpus())
    assert wordbpe.digests(empty, vocabulary()).count() == 0
    ids = spark.createDataFrame([(1, t.encode("Hello worlds", add_special_tokens=False).ids), (2, []), (3, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in wordbpe.decoded(ids, vocabulary()).collect()} == {1: t.decode(t.encode("Hello worlds", add_special_tokens=False).ids, skip_special_tokens=False), 2: "", 3: ""}


def test_splitter_is_the_tokenizers():
    s, t = wordbpe.Splitter(vocabulary()), wordbpe.tokenizer(vocabulary())
    draw = random.Random(4)
    signs = "abcXYZéßÅŁıİΣσς'sdm0193²½ªº_-.,!&<|>\t\n\u00a0\u2003\u0301漢字한글🙂"
    for _ in range(400):
        text = "".join(draw.choice(signs) for _ in range(draw.randint(0, 30)))
        assert [i for w in s.words(text) for i in t.encode(w, add_special_tokens=False).ids] == t.encode(text, add_special_tokens=False).ids, text


# --- 4 -----------------------------------------------------------------------------------------


def mix64(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<q", v), seed=h % 2**64)
        h -= 2**64 * (h >= 2**63)
    return h


def brute_sketch(text):
    w = [mix64(x.encode()) for x in WORD.findall(text)]
    if len(w) >= 5:
        grams = {mix64(*w[i : i + 5]) for i in range(len(w) - 4)}
    elif w:
        h = 0
        for x in w:
            h = mix64(h, x)
        grams = {h}
    else:
        return []
    return sorted(x for x in grams if x < -(2**63) + 2**61) or [min(grams)]


def test_fingerprints(docs, empty):
    rows = sorted(((r[0], r[1] or "") for r in corpus()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    shown = lambda s: "".join(f"{x % 2**64:016x}" for x in s)

    def contained(a, b):
        return len(set(a) & set(b)) / len(a) if a else float(not b)

    want = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        a, e, n = brute_sketch(text), brute_sketch(edited), brute_sketch(after)
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(e), round(max(contained(a, e), contained(e, a)), 9), round(max(contained(a, n), contained(n, a)), 9)))
    for buckets in (1, 4):
        found = scaled_sketch.fingerprints(docs, buckets=buckets).collect()
        assert many((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in found) == many(want)
    assert scaled_sketch.fingerprints(empty).count() == 0


def test_merged_sketch(spark):
    a, b = "a b c d e f g h i j k l", "m n o p q r s t u v w x"
    df = spark.createDataFrame([(a, b)], "a string, b string").select(scaled_sketch.merged(scaled_sketch.sketch(F.col("a"), 2), scaled_sketch.sketch(F.col("b"), 2), 2).alias("m"), scaled_sketch.sketch(F.col("a"), 2).alias("a"), scaled_sketch.sketch(F.col("b"), 2).alias("b"))
    r = df.first()
    assert r.m == sorted(set(r.a) | set(r.b))


# --- 5 -----------------------------------------------------------------------------------------


def filled(sizes, weights, most):
    total, live, out = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    left = total
    while live:
        level = left / sum(weights[i] for i in live)
        full = {i for i in live if weights[i] * level > most * sizes[i]}
        if not full:
            for i in live:
                out[i] = weights[i] * level
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        live -= full
    return out


def sainte_lague(targets, seats):
    won = [0] * len(targets)
    for _ in range(seats):
        best = max(range(len(targets)), key=lambda i: (targets[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


def test_targets_and_quotas(spark):
    draw = random.Random(8)
    for n in (1, 2, 7, 23):
        sizes = [draw.choice([3, 50, 700, 9000]) for _ in range(n)]
        df = spark.createDataFrame([(f"s{i:02d}" if i < n - 1 or n == 1 else None, s) for i, s in enumerate(sizes)], "source string, source_size long")
        shares = mixing.targets(df, [1, 2, 3], 3)
        got = [r.target for r in shares.orderBy(F.col("source").asc_nulls_last()).collect()]
        want = filled(sizes, [i % 3 + 1 for i in range(n)], 3)
        assert got == pytest.approx(want)
        seats = 57
        q = mixing.quotas(shares, F.lit(seats), 4).groupBy("source").agg(F.sum("quota").alias("q"), F.min("quota").alias("least")).orderBy(F.col("source").asc_nulls_last()).collect()
        assert [r.q for r in q] == sainte_lague(want, seats) and min(r.least for r in q) >= 0


def test_mix(docs, empty):
    rows = mixing.mix(docs, block=16)[0].collect()
    again = mixing.mix(docs.repartition(5), block=16)[0].collect()
    assert many(rows) == many(again)
    sizes = Counter()
    for r in corpus():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    taken = Counter()
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    for r in rows:
        assert abs(taken[r.source] - r.target) <= 3 * 16
    assert sum(len(WORD.findall(r[1] or "")) for r in corpus()) == pytest.approx(sum({r.source: r.target for r in rows}.values()))
    assert mixing.mix(empty)[0].count() == 0


def test_blocks_are_taken_in_seeded_order(docs):
    """Every source's line of words, cut into blocks, against a plain walk through its shards' quotas."""
    mixed, shared = (x.collect() for x in mixing.mix(docs, block=16, seed=3))
    quota, lines = {}, {}
    for r in shared:
        quota.setdefault(r.source, [0] * 8)[r.shard] = r.quota
    for r in mixed:
        lines.setdefault(r.source, []).append(r)
    for source, rows in lines.items():
        rows.sort(key=lambda r: (key52("null" if r.doc_id is None else r.doc_id, 3, "mix"), r.doc_id is not None, r.doc_id, r.text_crc32, r.size))
        n = max(1, -(-sum(r.size for r in rows) // 16))
        order = sorted(range(n), key=lambda b: (key52("null" if source is None else source, 3, b, "block"), b))
        uses = {}
        for place in range(min(sum(quota[source]), 3 * n)):
            shard = next(s for s in range(8) if place < sum(quota[source][: s + 1]))
            uses.setdefault(order[place % n], []).append(shard)
        at, want = 0, []
        for r in rows:
            of = uses.get((at + r.size // 2) // 16, []) if r.size else []
            want.append((r.doc_id, r.text_crc32, sum(len(uses.get(k // 16, [])) for k in range(at, at + r.size)), len(of), min(of, default=None)))
            at += r.size
        assert many((r.doc_id, r.text_crc32, r.taken, r.copies, r.first_shard) for r in rows) == many(want)


# --- 6 -----------------------------------------------------------------------------------------


def rated(spark, n, seed):
    draw = random.Random(seed)
    names = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(3, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        w = [draw.choice(names) for _ in range(draw.randint(30, 150))]
        grade = draw.choice([0, 1, 2, 2, 2])
        if grade == 0:
            w = [x + draw.choice(["%%%", "###"]) for x in w]
        if grade == 1:
            w.insert(draw.randrange(len(w)), draw.choice(["idiot", "moron"]))
        rows.append((i, " ".join(w), int(grade > 0), int(grade == 1)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "quality", "toxic")


def test_classifier_on_held_out_rows(spark):
    docs, labels = rated(spark, 900, 6)
    model = ordinal.trained(docs, labels.where("doc_id < 600"), most=500)
    assert (np.diff(model.cuts) >= 0).all()
    out = ordinal.scored(docs, model).join(ordinal.ratings(labels), "doc_id").where("doc_id >= 600")
    good = out.where((F.col("grade") == 2) == F.col("kept")).count()
    assert good / 300 >= 0.95
    means = {r.grade: r.m for r in out.groupBy("grade").agg(F.avg("expected_grade").alias("m")).collect()}
    assert means[0] < means[2] and means[1] < means[2]


def test_classifier_edges(spark, docs, empty):
    _, labels = rated(spark, 3, 1)
    one = ordinal.trained(docs, labels.limit(0))
    assert ordinal.scored(docs, one).where("kept").count() == len(corpus())
    assert ordinal.scored(empty, one).count() == 0
    assert ordinal.fit([np.array([1, 2], np.int32)] * 5, np.array([1] * 5)).cuts.tolist() == [-8.0, 8.001]


# --- 7 -----------------------------------------------------------------------------------------


def test_lm_base_and_masses(docs, empty):
    found = pitman_yor.scored(docs).collect()
    tokens = [(r[0], [*WORD.findall((r[1] or "").translate(LOWER)), "\n"]) for r in corpus()]
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    count = Counter(w for i, t in tokens if not out(i) for w in t)
    n, v = sum(count.values()), len(count)
    want = many((i, out(i), len(t), sum(count[w] > 0 for w in t), n) for i, t in tokens)
    assert many((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in found) == want
    base = sorted((sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), len(t)) for _, t in tokens)
    assert np.allclose(base, sorted((r.base_score, r.n_tokens) for r in found), rtol=1e-6)
    assert all(r.score < 0 for r in found) and sum(r.score for r in found) > sum(r.base_score for r in found)
    again = pitman_yor.scored(docs.coalesce(1)).collect()
    assert np.allclose(sorted(r.score for r in again), sorted(r.score for r in found), rtol=1e-5)
    assert pitman_yor.scored(empty).count() == 0


def test_lm_without_training_rows(spark):
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = pitman_yor.scored(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, round(r.score, 9), round(r.base_score, 9)) == (3, 0, 0, 0.0, 0.0)


def test_lm_rare_contexts_stay_apart(spark, monkeypatch):
    """Beyond the common words a context is its word and no other's, and the scores are those of a table where all words are common."""
    seen = {}
    for i in range(10_000):
        first = seen.setdefault(xxhash.xxh3_64_intdigest(f"w{i}".encode()) % 4096, f"w{i}")
        if first != f"w{i}":
            break
    second = f"w{i}"
    ids = iter(i for i in range(4000) if zlib.crc32(str(i).encode()) % 10)
    rng = random.Random(5)
    rows = [(next(ids), f"{a} {b} {rng.choice('pqrst')}{rng.randrange(40)}") for a, b in ((first, "left"), (second, "right")) for _ in range(300)]
    held = [i for i in range(10**5) if zlib.crc32(str(i).encode()) % 10 == 0][-4:]
    rows += list(zip(held, [f"{first} left", f"{first} right", f"{second} right", "q1 unseen left"], strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {r.doc_id: r.score for r in pitman_yor.scored(docs).collect()}
    monkeypatch.setattr(pitman_yor, "COMMON", 2)
    monkeypatch.setattr(pitman_yor, "BUCKET_TOKENS", 400)
    found = {r.doc_id: r.score for r in pitman_yor.scored(docs).collect()}
    assert found[held[0]] > found[held[1]] + 0.5
    # Two seeds differ by as much as 0.4 in one document.
    assert max(abs(found[i] - want[i]) for i in want) < 0.8 and np.mean(list(found.values())) == pytest.approx(np.mean(list(want.values())), rel=0.04)


def test_strength_of_counted_restaurants():
    """Restaurants given by counts draw as those given one by one, few and many of a kind."""
    c, t = np.repeat([2, 3, 9], [1500, 40, 7]), np.repeat([1, 2, 5], [1500, 40, 7])
    none = np.zeros(0, np.int64)
    one = [pitman_yor.strength(2.0, 0.75, c, t, np.random.default_rng(i)) for i in range(200)]
    some = [pitman_yor.strength(2.0, 0.75, none, none, np.random.default_rng(i), ({2: 1500, 3: 40, 9: 7}, {1: 1500, 2: 40, 5: 7})) for i in range(200)]
    assert np.mean(some) == pytest.approx(np.mean(one), rel=0.03)


def test_predictive_masses_sum_to_one():
    """Over all known words and one unknown, in every context, from the state that the sampler leaves."""
    draw = np.random.default_rng(2)
    v, contexts = 6, 8
    counts = draw.integers(0, 9, (contexts, v))
    w, u = np.nonzero(counts.T)
    c = counts[u, w].astype(np.int64)
    known = pitman_yor.Words(int(counts.sum()), v, np.arange(v, dtype=np.uint64), counts.sum(0), 1)
    sweeps = []
    for k in range(3):
        tables = pitman_yor.replayed(0, (w, u, c), sweeps, known, 1, last=True)[-1][0]
        assert (tables >= 1).all() and (tables <= c).all()
        on = np.bincount(w, tables, v).astype(np.int64)
        root = np.minimum(on, 1) if not sweeps else pitman_yor.reseated_root(on, sweeps[-1].common_root, sweeps[-1], v, np.random.default_rng(k))
        sweeps.append(pitman_yor.Sweep(np.bincount(u, tables, known.contexts).astype(np.int64), on, root, (2.0, 3.0), int(tables.sum()), int(root.sum())))
        p = pitman_yor.root_probability(on, root, sweeps[-1], v)
        unknown = pitman_yor.root_probability(np.zeros(1), np.zeros(1), sweeps[-1], v)
        assert p.sum() + unknown[0] == pytest.approx(1)
        customers = counts.sum(1)
        for ctx in range(contexts):
            mine = np.zeros(v)
            mine[w[u == ctx]] = np.maximum(c[u == ctx] - pitman_yor.DISCOUNTS[1] * tables[u == ctx], 0)
            back = 3.0 + pitman_yor.DISCOUNTS[1] * sweeps[-1].tables[ctx]
            assert (mine.sum() + back * (p.sum() + unknown[0])) / (3.0 + customers[ctx]) == pytest.approx(1)


def seatings(c, d=0.5):
    """log S(c, t) for t from 1 to c, by the recursion over customers."""
    row = np.array([0.0])
    for j in range(1, c):
        t = np.arange(1, j + 1)
        row = np.logaddexp(np.append(row + np.log(j - d * t), -np.inf), np.append(-np.inf, row))
    return row


@pytest.mark.parametrize("c, others, parent", [(20, 5.0, 0.2), (20, 50.0, 0.01), (30, 100.0, 0.05), (200, 50.0, 0.05), (2000, 50.0, 0.05), (2, 1.0, 0.5), (40, 1e5, 0.3)])
def test_tables_are_drawn_from_the_exact_conditional(c, others, parent):
    n = 40_000
    got = pitman_yor.seated(np.full(n, c), np.full(n, others), np.full(n, parent), np.random.default_rng(4))
    t = np.arange(1, c + 1)
    logs = seatings(c) + np.cumsum(np.log(others + 0.5 * (t - 1))) + t * math.log(parent)
    want = np.exp(logs - np.logaddexp.reduce(logs))
    share = np.bincount(got, minlength=c + 1)[1:] / n
    assert np.abs(share - want).max() < 5 * math.sqrt(0.25 / n) and got.mean() == pytest.approx((t * want).sum(), rel=0.02)
    assert pitman_yor.seated(np.array([10**9]), np.array([others]), np.array([parent]), np.random.default_rng(1))[0] >= 1


def test_strength_of_large_restaurants():
    """Restaurants beyond those that are drawn for together: the mean is that of plain auxiliary draws."""
    c, t = np.array([9000, 5, 20_000]), np.array([60, 2, 5000])
    got = [pitman_yor.strength(3.0, 0.5, c, t, np.random.default_rng(i)) for i in range(300)]
    want = []
    for i in range(300):
        rng = np.random.default_rng([7, i])
        flips = sum((rng.random(k - 1) < 3.0 / (3.0 + 0.5 * np.arange(1, k))).sum() for k in t)
        want.append(rng.gamma(1 + flips, 1 / (1 - np.log(rng.beta(4.0, c - 1)).sum())))
    assert np.mean(got) == pytest.approx(np.mean(want), rel=0.05)


def test_predictions_match_a_sampler_of_single_customers():
    """On a small corpus, the averaged predictive probabilities are those of a sampler that unseats and reseats one customer at a time."""
    draw = np.random.default_rng(6)
    v, contexts, s0, s1, d = 5, 6, 2.0, 3.0, 0.5
    counts = draw.integers(0, 7, (contexts, v))
    w, u = np.nonzero(counts.T)
    c = counts[u, w].astype(np.int64)
    known = pitman_yor.Words(int(counts.sum()), v, np.arange(v, dtype=np.uint64), counts.sum(0), 1)
    sweeps, p, rounds = [], np.zeros((contexts, v)), 400
    tables = np.minimum(c, 1)
    on_root = np.minimum(np.bincount(w, tables, v), 1)
    for k in range(rounds):
        on = np.bincount(w, tables, v).astype(np.int64)
        state = pitman_yor.Sweep(np.bincount(u, tables, known.contexts).astype(np.int64), on, on_root, (s0, s1), int(tables.sum()), int(on_root.sum()))
        root = pitman_yor.root_probability(on, on_root, state, v)
        rng = np.random.default_rng(k)
        tables = pitman_yor.seated(c, s1 + d * np.maximum(state.tables[u] - tables, 0), root[w], rng)
        on = np.bincount(w, tables, v).astype(np.int64)
        on_root = pitman_yor.reseated_root(on, np.minimum(on_root, on), state, v, rng)
        state = pitman_yor.Sweep(np.bincount(u, tables, known.contexts).astype(np.int64), on, on_root, (s0, s1), int(tables.sum()), int(on_root.sum()))
        root = pitman_yor.root_probability(on, on_root, state, v)
        left = np.zeros((contexts, v))
        left[u, w] = c - d * tables
        if k >= 40:
            p += (left + (s1 + d * state.tables[:contexts, None]) * root) / (s1 + counts.sum(1)[:, None])
    p /= rounds - 40

    random_ = random.Random(7)
    seats = {(x, y): [] for x in range(contexts) for y in range(v)}
    top = {y: [] for y in range(v)}

    def base(y):
        n, m = sum(map(sum, top.values())), sum(map(len, top.values()))
        return (max(sum(top[y]) - d * len(top[y]), 0) + (s0 + d * m) / (v + 1)) / (s0 + n)

    def sit(rows, new):
        weights = [k - d for k in rows] + [new]
        at = random_.choices(range(len(weights)), weights)[0]
        if at == len(rows):
            rows.append(1)
            return True
        rows[at] += 1
        return False

    def leave(rows):
        at = random_.choices(range(len(rows)), rows)[0]
        rows[at] -= 1
        if not rows[at]:
            rows.pop(at)
            return True
        return False

    def add(x, y):
        m = sum(len(seats[x, z]) for z in range(v))
        if sit(seats[x, y], (s1 + d * m) * base(y)):
            sit(top[y], (s0 + d * sum(map(len, top.values()))) / (v + 1))

    for x in range(contexts):
        for y in range(v):
            for _ in range(counts[x, y]):
                add(x, y)
    q, passes = np.zeros((contexts, v)), 500
    for k in range(passes):
        for x in range(contexts):
            for y in range(v):
                for _ in range(counts[x, y]):
                    if leave(seats[x, y]):
                        leave(top[y])
                    add(x, y)
        for x in range(contexts):
            m = sum(len(seats[x, z]) for z in range(v))
            for y in range(v):
                q[x, y] += (counts[x, y] - d * len(seats[x, y]) + (s1 + d * m) * base(y)) / (s1 + counts[x].sum())
    q /= passes
    assert np.abs(np.log10(p / q)).max() < 0.04


# --- 8 -----------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><a href=/>Site</a><h2>Tagline</h2></header><nav><ul><li><a href=x>menu</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="content" class="with sidebar"><article class="post"><header><h1>Title &amp; more</h1></header><p>One  two\n three.<p>Four <b>five</b> si&#120;.<div class="ad">Buy</div>
<ul><li>a<li>b</ul><form>name <input></form><table><tr><td>x<td>y</table><script>var a="<p>no</p>";</script></article><section id="comments"><p>Reader says a very long comment, longer than the article itself.</p></section></div><aside>Side</aside><footer>foot</footer></body></html>"""


def test_main_text():
    assert density_html.main_text(PAGE) == "Title & more\nOne two three.\nFour five six.\na\nb\nx\ny"
    for page, text in ((None, ""), ("", ""), (" \n", ""), ("plain text", "plain text"), ("<p>a &lt;b&gt; <i>c</i>", "a <b> c"), ("<article><p>cut off in a tag <a hre", "cut off in a tag"), ("<script>only()", ""), ("<p hidden>x</p><p>y y y</p>", "y y y")):
        assert density_html.main_text(page) == text
    body = "<div class=menu><a href=1>one</a><a href=2>two</a></div><div><h1>Head</h1><div><p>A long enough paragraph of text.</p><p>And one more of these, also long.</p></div></div>"
    assert density_html.main_text(f"<html><body>{body}</body></html>") == "Head\nA long enough paragraph of text.\nAnd one more of these, also long."
    assert density_html.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_second_body_after_a_long_head():
    """A second body tag is ignored however many elements the head has."""
    for n in (3, 200):
        page = "<html><head>" + "<meta name=x>" * n + "</head><body><article><p>" + "First words of it. " * 9 + "</p><body><p>" + "Last words of it. " * 9 + "</p></article></body></html>"
        _, nodes, _ = density_html.parse(page)
        assert sum(x.tag == "body" for x in nodes) == 1


def test_extracted(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (None, None, None, "y"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    assert many((r.page_id, r.url, r.text, r.n_chars) for r in density_html.extracted(pages).collect()) == many([(i, u, t := density_html.main_text(h), len(t)) for i, u, h in ((1, "u", PAGE), (None, None, None), (1, "u", PAGE))])
    assert density_html.extracted(pages.limit(0)).count() == 0


def plain_page(draw):
    """A page without article, main or any mark: its article, and lists of links and short lines around it, all in div elements."""
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randint(3, 8)))
    body = [" ".join(word() for _ in range(draw.randint(30, 80))) for _ in range(draw.randint(3, 9))]
    links = lambda: "<div>" + "".join(f'<div><a href="/{word()}">{word()} {word()}</a></div>' for _ in range(draw.randint(4, 12))) + "</div>"
    return f"<html><body>{links()}<div><div>" + "".join(f"<p>{p}</p>" for p in body) + f"</div></div>{links()}</body></html>", "\n".join(body)


def test_density_decides(monkeypatch):
    """Where nothing is marked, densities alone find the article; the opposite densities find something else; article is a name like div."""
    draw = random.Random(8)
    pages = [plain_page(draw) for _ in range(60)]
    assert all(density_html.main_text(page) == text for page, text in pages)
    assert all(density_html.main_text(page.replace("<div><div><p>", "<article><div><p>").replace("</p></div></div>", "</p></div></article>")) == text for page, text in pages)
    ran = density_html.densities

    def opposite(root, nodes, stream):
        ran(root, nodes, stream)
        for n in nodes:
            n.density, n.total = -n.density, -n.total

    monkeypatch.setattr(density_html, "densities", opposite)
    assert sum(density_html.main_text(page) != text for page, text in pages) > 50


def test_long_and_wide_pages():
    words = " ".join(f"word{i}" for i in range(200_000))
    assert density_html.main_text(f"<div><p>{words}</p></div>") == words
    wide = "".join(f"<p>line number {i} of many, with some more words</p>" for i in range(20_000))
    assert density_html.main_text(f"<body><div>{wide}</div></body>").count("\n") == 19_999


# --- 9 -----------------------------------------------------------------------------------------


def brute_components(rows, n, percent):
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset())
    of = list(range(len(rows)))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                of[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return many((key, len(sets[i]), least.get(find(i)) if sets[i] else key) for i, (key, _) in enumerate(rows))


def family(seed):
    """Chains of edits, families of near copies, and texts that share passages but are not alike."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(4))
    shared, texts = [word() for _ in range(60)], []
    for size in (8, 20, 45, 100):
        base = [word() for _ in range(size)]
        texts += [" ".join(base)] * 2
        for edits in range(1, 9):
            t = base[:]
            for _ in range(edits):
                t[draw.randrange(len(t))] = word()
            texts.append(" ".join(t))
        texts += [" ".join(shared[: size // 2] + [word() for _ in range(size)]) for _ in range(4)]
    return [(i * 2, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("percent, shingle, pair_cost", [(90, 3, 8.0), (80, 5, 8.0), (80, 2, 1e9), (70, 1, 1e9)])
def test_join(spark, monkeypatch, percent, shingle, pair_cost):
    monkeypatch.setattr(segjoin, "PAIR_COST", pair_cost)
    monkeypatch.setattr(segjoin, "BLOCK", 4096 if shingle > 2 else 3)
    rows = family(percent + shingle)
    found = segjoin.joined(spark.createDataFrame(rows, "doc_id long, text string"), percent, shingle).collect()
    assert many((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(rows, shingle, percent)


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_components_settle(spark, kind):
    draw = random.Random(kind)
    n = 300
    links = {"chain": [(i, i + 1) for i in range(n - 1)], "star": [(0, i) for i in range(1, n)], "random": [(draw.randrange(n), draw.randrange(n)) for _ in range(n * 2 // 3)], "none": []}[kind]
    names = list(range(n))
    draw.shuffle(names)
    links = [(names[a], names[b]) for a, b in links * 2]
    of = list(range(n))
    for _ in range(n):
        before = of[:]
        for a, b in links:
            of[a] = of[b] = min(of[a], of[b])
        if of == before:
            break
    found = segjoin.components(spark.range(n), spark.createDataFrame(links, "a long, b long"), "id").collect()
    assert sorted((r.id, r.component) for r in found) == list(enumerate(of))


def test_join_on_hard_rows(docs, empty):
    found = segjoin.joined(docs).collect()
    assert many((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components([(r[0], r[1]) for r in corpus()], 3, 90)
    assert segjoin.joined(empty).count() == 0


def meet(x, y):
    """Whether two sets of (signature, active) make a pair a candidate."""
    forms = {(v & -4, v & 3): on for v, on in y}
    partner = {segjoin.WHOLE: segjoin.WHOLE, segjoin.FULL: segjoin.LESS, segjoin.LESS: segjoin.FULL}
    return any((other := forms.get((v & -4, partner[v & 3]))) is not None and (on or other) for v, on in x)


@pytest.mark.parametrize("percent", [70, 80, 90])
def test_allotted_values_lose_no_pair(percent):
    """Any two similar sets, whichever of their agreeing segments both drop, share an index entry or an allotted neighbour."""
    draw, bands, met = np.random.default_rng(percent), segjoin.Bands(percent), 0
    for _ in range(1500):
        s = np.unique(draw.integers(0, 2**64, draw.integers(1, 60), np.uint64))
        apart = draw.integers(0, (100 - percent) * len(s) // 50 + 2)
        gone = draw.integers(0, apart + 1)
        t = np.unique(np.append(draw.permutation(s)[min(gone, len(s) - 1) :], draw.integers(0, 2**64, apart - gone, np.uint64)))
        common = len(np.intersect1d(s, t))
        if 100 * common < percent * (len(s) + len(t) - common):
            continue
        met += 1
        both = [segjoin.indexed(x, bands) for x in (s, t)]
        assert meet(*[{(int(v), True) for v in x} for x in both])
        cost = {}
        rows = []
        for x in (s, t):
            found = set()
            for band in bands.used(len(x)):
                m = bands.segments(band)
                starts, sums = segjoin.parts(x, m)
                own, full = segjoin.signature(band, np.arange(m), sums), np.diff(starts) > 0
                slack, empty = bands.slack(band, len(x)), int((~full).sum())
                # Every segment is as dear as can be, in an order that belongs to its content.
                order = sorted(np.flatnonzero(full), key=lambda k: cost.setdefault(int(own[k]), draw.random()))
                dropped = order[: max(0, (m + slack) // 2 - empty)]
                found |= {(int(own[k]), k not in dropped) for k in np.flatnonzero(full)}
                if 2 * empty > m + slack:
                    found |= {(int(own[k]), True) for k in np.flatnonzero(~full)}
                e = empty + len(dropped)
                if e > slack:
                    found |= {(int(v), True) for v in np.concatenate(segjoin.neighbours(band, x, m, min(m, 2 * e - slack)))}
            rows.append(found)
        assert meet(*rows)
    assert met > 300


def test_costly_segments_give_way(spark, monkeypatch):
    """At the default costs sets of many groups that share most words are looked up by one-deletion neighbours, and nothing is lost."""
    draw = random.Random(1)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    core = [word() for _ in range(26)]
    rows = []
    for g in range(40):
        base = core + [word() for _ in range(9)]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join([*base[:-1], word()]))]
    seen = []
    ran = segjoin.cross_pairs
    monkeypatch.setattr(segjoin, "cross_pairs", lambda members, *rest: seen.extend(members.collect()) or ran(members, *rest))
    found = segjoin.joined(spark.createDataFrame(rows, "doc_id long, text string"), 80, 1).collect()
    assert many((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(rows, 1, 80)
    assert any(not r.active for r in seen)
    indexed = {int(v) for _, t in rows for v in segjoin.indexed(segjoin.Shingler(1)(t)[0], segjoin.Bands(80))}
    assert any(r.sig not in indexed for r in seen)


def test_family_of_a_thousand(spark):
    """A thousand near copies of one text, some of which only a chain joins, and texts of their own."""
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(60)]
    rows = []
    for i in range(1000):
        t = base[:]
        for _ in range(draw.randint(0, 2)):
            t[draw.randrange(60)] = word()
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, " ".join(word() for _ in range(60))) for i in range(100)]
    found = segjoin.joined(spark.createDataFrame(rows, "doc_id long, text string"), 90, 1).collect()
    assert many((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(rows, 1, 90)


def made_by_arrow(spark):
    """Rows that MapInArrow has made in each execution so far, by execution."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs, made = store.executionsList(), {}
    for id in (runs.apply(i).executionId() for i in range(runs.size())):
        nodes, values = store.planGraph(id).allNodes(), store.executionMetrics(id)
        for node in (nodes.apply(k) for k in range(nodes.size())):
            for m in (node.metrics().apply(k) for k in range(node.metrics().size())) if "MapInArrow" in node.name() else ():
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    made[id] = made.get(id, 0) + int(values.apply(m.accumulatorId()).replace(",", ""))
    return made


@pytest.mark.parametrize(("share", "held"), [(1 << 15, 1 << 18), (40, 16)])
def test_pairs_that_meet_often_become_few_rows(spark, monkeypatch, share, held):
    """Sets just below the threshold meet in most of their segments; none is lost, and a task makes each pair one row."""
    monkeypatch.setattr(segjoin, "SHARE", share, raising=False)
    monkeypatch.setattr(segjoin, "HELD", held, raising=False)
    draw, bands = np.random.default_rng(4), segjoin.Bands(80)
    base = draw.integers(0, 2**64, 400, np.uint64)
    sets = [np.unique(np.append(np.delete(base, draw.choice(400, 23, False)), draw.integers(0, 2**64, 23, np.uint64))) for _ in range(14)]
    names = [bytes([i + 1]) * 16 for i in range(len(sets))]
    members = [(int(v), bytearray(n), bytearray(n), True) for s, n in zip(sets, names, strict=True) for v in set(segjoin.indexed(s, bands).tolist())]
    fit = {(a, b) for a in range(14) for b in range(a + 1, 14) if np.bitwise_count(np.frombuffer(segjoin.parity(sets[a]), np.uint8) ^ np.frombuffer(segjoin.parity(sets[b]), np.uint8)).sum() <= 20 * (len(sets[a]) + len(sets[b])) // 180}
    at = [{sig for sig, n, *_ in members if n == name} for name in names]
    meetings = sum(len(at[a] & at[b]) for a, b in fit)
    before = set(made_by_arrow(spark))
    kept = spark.createDataFrame([(bytearray(n), len(s), bytearray(segjoin.parity(s))) for n, s in zip(names, sets, strict=True)], "class binary, size long, parity binary")
    found = segjoin.cross_pairs(spark.createDataFrame(members, "sig long, class binary, component binary, active boolean"), kept, 80)
    assert many((names.index(bytes(r.a)), names.index(bytes(r.b))) for r in found.collect()) == many(fit)
    made = sum(n for id, n in made_by_arrow(spark).items() if id not in before)
    assert len(fit) > 50 and len(fit) <= made
    if share > 40:
        assert 5 * made < meetings


def test_join_drops_tables_it_no_longer_reads(spark, monkeypatch):
    """Signatures are gone before values are allotted, and only what the result reads is left."""
    live, then = {}, []
    put, gone, ran = segjoin.written, segjoin.discard, segjoin.cross_pairs

    def written(df, label):
        out = put(df, label)
        live[out.written_to] = label
        return out

    def discard(*tables):
        for t in tables:
            live.pop(t.written_to, None)
        gone(*tables)

    monkeypatch.setattr(segjoin, "written", written)
    monkeypatch.setattr(segjoin, "discard", discard)
    monkeypatch.setattr(segjoin, "cross_pairs", lambda *rest: then.extend(live.values()) or ran(*rest))
    rows = [(i, " ".join(f"w{(i * 7 + k * (1 + i % 3)) % 60}" for k in range(40))) for i in range(60)]
    found = segjoin.joined(spark.createDataFrame(rows, "doc_id long, text string"), 80, 1)
    assert then and not {"join-signed", "join-members", "join-between"} & set(then)
    assert not {"join-signed", "join-sets", "join-allotted", "join-useful"} & set(live.values())
    assert many((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == brute_components(rows, 1, 80)


def test_bands():
    for percent in (80, 90):
        b = segjoin.Bands(percent)
        for small in [*range(1, 400), 5000]:
            assert b.low(b.of(small)) <= small < b.low(b.of(small) + 1)
            for large in {small, small * 100 // percent}:
                assert b.of(small) in b.used(large) and b.of(large) - b.of(small) <= 1
                common = -(-percent * (small + large) // (100 + percent))
                assert all(b.segments(b.of(small)) - 1 - b.slack(b.of(small), n) >= small + large - 2 * common for n in (small, large))
                assert b.slack(b.of(small), large) >= 0
                assert small + large - 2 * common < b.segments(b.of(small))


# --- 10 ----------------------------------------------------------------------------------------


def brute_rule(url):
    m = re.match(r"[\s\S]*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
    fit = [(len(h + p), h + p, v) for v, h, p in urlglob.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *((max(fit)[1], max(fit)[2]) if fit else (None, None))


URLS = [
    None, "", "no scheme", "http://net/", "http://net", "HTTPS://A.B.NET/x?y=/z#w", "http://example.net/en/1", "http://m.Example.net/en", "http://notexample.net/en/2", "http://x.example.com/de/#q", "http://example.com/DE/", "ftp://w.org/fr/a://b",
    "http://org.net.com/fr/", "http://ads-1.example.org/fr/", "http://m.ads-track.example.com/es/1/", "http://a.com/ads/x", "http://a.com/x.net/", "http://a.net?x", "http://a.net:80/", "http://netx/", "x://é.org/fr/é",
]


def test_urls(spark):
    pages = spark.createDataFrame([(None if i == 4 else i, u, "x") for i, u in enumerate(URLS + URLS[:6])], "page_id long, url string, host string")
    for r in urlglob.filtered(pages.select("page_id", "url", "host")).join(pages.select(F.col("page_id"), F.col("url").alias("u")), "page_id").collect():
        host, path, rule, verdict = brute_rule(r.u)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict)
    found = {r.page_id: r.verdict for r in urlglob.filtered(pages).collect()}
    assert found[0] == found[1] == found[2] == "allow" and found[14] == found[15] == "block" and found[13] == "allow"
    assert urlglob.filtered(pages.limit(0)).count() == 0


def test_automaton_against_patterns():
    draw = random.Random(9)
    globs = ["".join(draw.choice(["a", "b", "/", "?", "*", "**", "."]) for _ in range(draw.randint(0, 7))) for _ in range(60)]
    machine = urlglob.Automaton.of(globs)
    forms = [re.compile("".join({"**": "[\\s\\S]*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in re.findall(r"\*\*|[\s\S]", g))) for g in globs]
    for _ in range(300):
        text = "".join(draw.choice("ab/.c") for _ in range(draw.randint(0, 8)))
        assert machine.matches(text) == [k for k, f in enumerate(forms) if f.fullmatch(text)], text


# --- shared ------------------------------------------------------------------------------------


def test_words_and_folders(spark, docs):
    got = docs.select("text", common.words(F.col("text")).alias("w")).collect()
    assert all(r.w == WORD.findall(r.text or "") for r in got)
    assert common.shared_dir(spark) == common.shared_dir(spark)


def test_signatures_meet_slice_by_slice(spark, monkeypatch):
    """signatures go through one shuffle, a slice of their places at a time, and copies count once."""
    put, slices = segjoin.written, []

    def written(df, label):
        if label == "join-met":
            slices.append((df._jdf.queryExecution().executedPlan().toString(), {r.place for r in df.collect()}))
        return put(df, label)

    monkeypatch.setattr(segjoin, "written", written)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        words = [f"w{k}" for k in range(60)]
        texts = [" ".join(words), " ".join([*words[:59], "other"]), " ".join(words), "alone here"]
        found = segjoin.joined(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), 80, 1).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert {r.doc_id: r.component_id for r in found} == {0: 0, 1: 0, 2: 0, 3: 3}
    assert len(slices) > 1 and sum(len(s) for _, s in slices) == len(set().union(*[s for _, s in slices])) > 0
    assert all(plan.count("- Exchange ") == 1 for plan, _ in slices)


def test_meeting_against_brute_force(spark):
    """places where two names meet, in kinds that fit; a name's copies are one."""
    draw = random.Random(6)
    rows = [(draw.randrange(40) * 4, draw.randrange(3), draw.randrange(5)) for _ in range(150)]
    met = {p for p, _, _ in rows if len({n for q, _, n in rows if q == p}) > 1}
    fit = {p for p in met if {segjoin.WHOLE} == (kinds := {k for q, k, _ in rows if q == p}) or kinds == {segjoin.FULL, segjoin.LESS} or kinds == {segjoin.WHOLE, segjoin.FULL, segjoin.LESS}}
    found = segjoin.meeting(spark.createDataFrame(rows, "place long, kind byte, name long").repartition(4)).collect()
    assert sorted(map(tuple, found)) == sorted({r for r in rows if r[0] in fit})
