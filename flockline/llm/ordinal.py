"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockline.llm.common import key52

BITS = 18
#: Grades: 0 poor, 1 well written but toxic, 2 good.
GRADES = 3
SHAPE = re.compile(r"[\w]+")
CACHE = 200_000


MASK = (1 << BITS) - 1
#: Characters of a word's stem; how often a text's words share a stem tells a topic.
STEM = 5


def hashed(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) & MASK


class Hasher:
    """The hashed features of a text, each present or not: its distinct words, their outer signs, stems that two and three of its words share, and its shape as a whole."""

    def __init__(self) -> None:
        self.cache: dict[str, tuple[int, int, int]] = {}

    def of_word(self, word: str) -> tuple[int, int, int]:
        bare = word.strip(".,;:!?\"'()").lower()
        signs = SHAPE.sub("", word)
        found = (hashed(bare), hashed(f"\x01{signs[:8]}{'U' if len(word) > 3 and word.isupper() else ''}"), hashed(f"\x03{bare[:STEM]}") if len(bare) >= STEM else -1)
        if len(self.cache) >= CACHE:
            self.cache.clear()
        self.cache[word] = found
        return found

    def features(self, text: str) -> np.ndarray:
        words = text.split()
        if not words:
            return np.array([self.flat("empty", 0)], np.int32)
        kinds = Counter(words)
        get, of_word = self.cache.get, self.of_word
        out: set[int] = set()
        stems: dict[int, int] = {}
        for w, times in kinds.items():
            word, form, stem = get(w) or of_word(w)
            out.add(word)
            out.add(form)
            stems[stem] = stems.get(stem, 0) + times
        stems.pop(-1, None)
        for stem, times in stems.items():
            if times > 1:
                out.add((stem * 5 + 1) & MASK)
                if times > 2:
                    out.add((stem * 5 + 2) & MASK)
        n = len(words)
        lines = [x for x in text.split("\n") if x.strip()]
        runs = sum(map(str.__eq__, words, words[1:]))
        upper = sum(map(str.isupper, words))
        signs = len(SHAPE.sub("", text)) - text.count(" ") - text.count("\n")
        # Shares of a few words say nothing.
        enough = n >= 10
        for name, share in (("kinds", len(kinds) / n if n >= 50 else 1.0), ("runs", runs / n), ("lines", 1 - len(set(lines)) / max(len(lines), 1)), ("upper", upper / n), ("signs", signs / max(len(text), 1)), ("pipes", words.count("|") / n)):
            out.add(self.flat(name, int(share * 12) if enough or name == "kinds" else 0))
        return np.fromiter(sorted(out), np.int32, len(out))

    def flat(self, name: str, step: int) -> int:
        return hashed(f"\x02{name}{step}")


@dataclass(frozen=True)
class Model:
    """P(grade <= k) = sigmoid(cuts[k] - weights . features); cuts rise."""

    weights: np.ndarray
    cuts: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 to the highest grade."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -30, 30)))


def fit(rows: list[np.ndarray], grades: np.ndarray, least_docs: int = 5, sparsity: float = 0.0003, steps: int = 600) -> Model:
    """Maximum likelihood with an L1 penalty, by accelerated proximal gradient; the cuts are kept in order by their gaps' logs.

    Features in fewer than ``least_docs`` documents have no weight. With one grade
    only, or no rows, the cuts put that grade (the highest, without rows) at near certainty.
    """
    n = len(rows)
    size = 1 << BITS
    if n == 0 or len(set(grades.tolist())) < 2:
        top = int(grades[0]) if n else GRADES - 1
        return Model(np.zeros(size), np.array([-8.0 + k * 1e-3 if k < top else 8.0 + k * 1e-3 for k in range(GRADES - 1)]))
    lengths = np.array([len(r) for r in rows])
    index = np.concatenate(rows)
    common = np.bincount(index, minlength=size) >= least_docs
    names = np.flatnonzero(common)
    number = np.full(size, -1)
    number[names] = np.arange(len(names))
    doc = np.repeat(np.arange(n), lengths)[common[index]]
    feature = number[index[common[index]]]
    share = np.array([(grades <= k).mean() for k in range(GRADES - 1)]).clip(1e-3, 1 - 1e-3)
    cuts = np.log(share / (1 - share))
    cuts = np.maximum.accumulate(cuts + np.arange(len(cuts)) * 1e-2)
    w = np.zeros(len(names))
    seen, momentum, previous, past_cuts, ahead = w.copy(), 1.0, w.copy(), cuts.copy(), cuts.copy()
    upper, lower = grades < GRADES - 1, grades > 0
    degree = np.bincount(feature, minlength=len(names))
    rate = 64.0 / max(np.bincount(doc, minlength=n).mean() ** 0.5, 1) / n
    pace = rate * n / np.sqrt(np.maximum(degree, 1)) / np.sqrt(n)  # steps in proportion to a feature's rarity
    for _ in range(steps):
        score = np.bincount(doc, seen[feature], minlength=n)
        high = np.where(upper, 1 / (1 + np.exp(np.clip(score - ahead[np.minimum(grades, GRADES - 2)], -30, 30))), 1.0)
        low = np.where(lower, 1 / (1 + np.exp(np.clip(score - ahead[np.maximum(grades - 1, 0)], -30, 30))), 0.0)
        likelihood = np.maximum(high - low, 1e-9)
        slope_high, slope_low = high * (1 - high) / likelihood, low * (1 - low) / likelihood
        slope = slope_high - slope_low  # of minus the log-likelihood by the score
        gradient = np.bincount(feature, slope[doc], minlength=len(names))
        cut_gradient = np.array([-(slope_high[grades == k].sum() - slope_low[grades == k + 1].sum()) for k in range(GRADES - 1)])
        moved = seen - pace * gradient / np.sqrt(n)
        moved = np.sign(moved) * np.maximum(np.abs(moved) - pace * sparsity * np.sqrt(n), 0)
        cuts = np.maximum.accumulate(ahead - 2.0 * cut_gradient / n)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        push = min((momentum - 1) / following, 0.9)
        seen, ahead = moved + push * (moved - previous), np.maximum.accumulate(cuts + push * (cuts - past_cuts))
        previous, past_cuts, momentum = moved, cuts, following
    weights = np.zeros(size)
    weights[names] = previous
    return Model(weights, past_cuts)


def ratings(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 for poor quality, 1 for toxic, 2 for neither; the lowest of a document's labels, without null ids or labels."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min(grade).alias("grade"))


def trained(docs: DataFrame, labels: DataFrame, most: int = 8000) -> Model:
    """A model of the documents that have ratings; of more than ``most`` rated ids about as many, those of least hash."""
    rated = ratings(labels)
    n = rated.count()
    bound = 2**52 if n <= most else int(2**52 * most / n)
    sample = rated.filter(key52(F.col("doc_id"), "ordinal") < bound).withColumnRenamed("doc_id", "__id")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).select("doc_id", "grade", "text")

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            found = [hasher.features(t.as_py() or "").astype("<i4").tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], ["doc_id", "grade", "features"])

    got = rows.mapInArrow(featurize, "doc_id long, grade int, features binary").orderBy("doc_id", "features").toPandas()
    return fit([np.frombuffer(x, "<i4") for x in got["features"]], got["grade"].to_numpy(np.int64) if len(got) else np.zeros(0, np.int64))


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), least: float = 0.5) -> DataFrame:
    """A row a document: ``keep``, expected_grade, p_good (the probability of the highest grade), kept (p_good >= ``least``).

    Null and blank texts have a feature of their own. Equal texts get equal grades;
    an empty table gives none. One pass without a shuffle; the model has 2**18 weights.
    """
    rows = docs.select(*[F.col(c).alias(c) for c in keep], F.col("text").alias("__text"))
    weights, cuts = model.weights.astype(np.float32), model.cuts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, m = Hasher(), Model(weights, cuts)
        for b in batches:
            score = np.array([float(weights[hasher.features(t.as_py() or "")].sum()) for t in b.column(len(keep))])
            tails = m.tails(score)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= least)], [*keep, "expected_grade", "p_good", "kept"])

    schema = rows.drop("__text").schema.add("expected_grade", "double").add("p_good", "double").add("kept", "boolean")
    return rows.mapInArrow(run, schema)
