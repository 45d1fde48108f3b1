"""Toxicity by class-conditional Kneser-Ney models.

Each class (toxic, ordinary) has an interpolated Kneser-Ney model of the letters of its
expressions, the distinct words of its texts: a letter given up to ``ORDER - 1`` before it,
from the word's start. Each class has its own counts and absolute discounts; what a discount
frees goes to the next shorter history by continuation counts (how many different letters stand
before), and grams of up to ``SHARED`` letters are counted for both classes together. A rare expression is thus judged by its beginnings and
endings, an unknown one by the shared counts, which speak for neither class.

Most of a toxic text is ordinary prose, so a toxic text is a mixture: each of its expressions
comes from the toxic model with probability ``SHARE``, else from the ordinary one. Counts are
split between the two by expectation maximisation (``ROUNDS`` rounds). The evidence of a text
is its log-likelihood as a toxic text less that as an ordinary one, normalised by its number of
expressions and by the square root of that number, and that of its most toxic expression alone
(one may stand in a long text); a logistic curve turns the three into a score.
In the curve a toxic row weighs as many ordinary ones as the root of how much rarer it is. It
is fitted on evidence from models that have not seen the text (``FOLDS`` folds); the
model that scores has seen the whole sample.

The sample is of labelled rows and bounded: at most ``MAX_TOXIC`` and ``MAX_ORDINARY`` rows,
the smallest by a hash of their id, whole texts. Of sampled texts with the same least shingle
hash, under either of two seeds, one is used: near copies are no independent evidence.

Nulls and empty texts have no words and score as texts without evidence; repeated rows each
get a row; null labels or ids are not learnt from, nor labels other than 0 and 1 (a row
labelled both ways is toxic). If either class has no row or no word, every score is 0. Letters
beyond the 4,092 most frequent of the sample count as one unknown letter.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import written
from .batches import pieces, send_small

MAX_TOXIC = 4000
MAX_ORDINARY = 12000
ORDER = 4
SHARED = 1
SHARE = 0.02
ROUNDS = 4
FOLDS = 3
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")
_BITS = 12  # of a letter's code: up to five letters make one 64-bit key
_UNKNOWN, _START, _END = 1, 2, 3
_BLOCK = 50_000  # expressions


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass
class Letters:
    """Codes of letters, the most frequent first."""

    points: np.ndarray  # code points in the order of their codes, from 4 on
    _table: np.ndarray | None = field(default=None, repr=False)

    def keys(self, expressions: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every letter and every end: the number of its expression, the length of its
        history with itself (at most ``ORDER``), and the key of that many letters, the last in
        the lowest bits."""
        if self._table is None:
            self._table = np.full(0x110000, _UNKNOWN, np.int64)
            self._table[self.points] = np.arange(4, 4 + len(self.points))
        line = "".join(expressions).encode("utf-32-le", "surrogatepass")
        sizes = np.fromiter(map(len, expressions), np.int64, len(expressions)) + 2
        ends = np.cumsum(sizes)
        codes = np.empty(int(sizes.sum()), np.int64)
        inner = np.ones(len(codes), bool)
        inner[ends - sizes] = inner[ends - 1] = False
        codes[inner] = self._table[np.frombuffer(line, np.uint32)]
        codes[ends - sizes], codes[ends - 1] = _START, _END
        owner = np.repeat(np.arange(len(expressions), dtype=np.int32), sizes)
        at = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
        length = np.minimum(at + 1, ORDER).astype(np.int8)
        keys = codes.copy()
        for n in range(1, ORDER):
            before = np.flatnonzero(length > n)
            keys[before] += codes[before - n] << (_BITS * n)
        said = at > 0
        return owner[said], length[said], keys[said]

    def __getstate__(self):
        return {"points": self.points, "_table": None}


def _last(keys: np.ndarray, letters: int) -> np.ndarray:
    return keys & ((1 << (_BITS * letters)) - 1)


class Grams:
    """All letter histories of a list of expressions, by length, with what they lead to."""

    def __init__(self, letters: Letters, expressions: list[str]):
        parts = []
        for first in range(0, max(len(expressions), 1), _BLOCK):  # a block at a time takes less memory
            owner, length, keys = letters.keys(expressions[first : first + _BLOCK])
            parts.append((owner + np.int32(first), length, keys))
        self.owner, length, keys = (np.concatenate(x) for x in zip(*parts))
        del parts
        self.expressions = len(expressions)
        self.own, self.at, self.below, self.context, self.contexts = {}, {}, {}, {}, {}
        longer = np.empty(0, np.int64)
        for n in range(ORDER, 0, -1):
            whole = np.flatnonzero(length == n).astype(np.int32)  # nothing stands before shorter ones
            self.own[n], back = np.unique(np.concatenate((keys[whole], _last(longer, n))), return_inverse=True)
            back = back.astype(np.int32)
            self.at[n], self.below[n + 1] = (whole, back[: len(whole)]), back[len(whole) :]
            self.contexts[n], self.context[n] = np.unique(self.own[n] >> _BITS, return_inverse=True)
            longer = self.own[n]

    def counts(self, n: np.ndarray) -> dict[int, np.ndarray]:
        """Kneser-Ney counts by length of ``n`` texts an expression: texts at full length and
        from a word's start, else how many different letters come before."""
        out = {}
        for length in range(ORDER, 0, -1):
            where, gram = self.at[length]
            out[length] = np.bincount(gram, n[self.owner[where]], len(self.own[length]))
            if length < ORDER:
                out[length] = out[length] + np.bincount(self.below[length + 1], out[length + 1] > 0, len(self.own[length]))
        return out

    def likely(self, counts: dict[int, np.ndarray], shared: dict[int, np.ndarray], letters: int):
        """Probabilities of the grams by length, and the weights of shorter histories."""
        p, weight = {0: np.array([1.0 / letters])}, {}
        for length in range(1, ORDER + 1):
            c = shared[length] if length <= SHARED else counts[length]
            once, twice = (c == 1).sum(), (c == 2).sum()
            discount = once / (once + 2 * twice) if once else 0.5
            size = len(self.contexts[length])
            total = np.bincount(self.context[length], c, size)
            freed = np.bincount(self.context[length], np.minimum(c, discount), size)
            seen = total > 0
            weight[length] = np.where(seen, freed / np.where(seen, total, 1), 1.0)
            held = np.maximum(c - discount, 0) / np.where(seen, total, 1)[self.context[length]]
            lower = p[length - 1][self.below[length]] if length > 1 else p[0][0]
            p[length] = held + weight[length][self.context[length]] * lower
        return p, weight


@dataclass
class Table:
    """Log-likelihood ratio of each gram by length, and of the weights of its histories."""

    ratios: dict[int, tuple[np.ndarray, np.ndarray]]
    weights: dict[int, tuple[np.ndarray, np.ndarray]]

    def of(self, letters: Letters, expressions: list[str]) -> np.ndarray:
        owner, length, keys = letters.keys(expressions)
        total = np.zeros(len(owner))
        left = np.arange(len(owner))
        for n in range(ORDER, SHARED, -1):
            now = left[length[left] >= n]
            gram, value = self.ratios[n]
            found, place = _find(gram, _last(keys[now], n))
            total[now[found]] += value[place]
            lost = now[~found]
            context, weight = self.weights[n]
            known, place = _find(context, _last(keys[lost], n) >> _BITS)
            total[lost[known]] += weight[place]
            left = np.concatenate((left[length[left] < n], lost))
        return np.bincount(owner, total, len(expressions))


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    found = table[place] == keys if len(table) else np.zeros(len(keys), bool)
    return found, place[found]


def mixed(ratio: np.ndarray) -> np.ndarray:
    """Log of a toxic text's probability of an expression over an ordinary text's."""
    return np.log1p(SHARE * np.expm1(np.minimum(ratio, 50.0)))


def estimate(grams: Grams, n: np.ndarray, letters: int) -> Table:
    """Class models of ``n`` (ordinary, toxic) texts an expression, after ``ROUNDS`` rounds of
    moving the ordinary expressions of toxic texts to the ordinary class."""
    toxic = n[:, 1].astype(float)
    for last in [False] * ROUNDS + [True]:
        counts = [grams.counts(n[:, 0] + n[:, 1] - toxic), grams.counts(toxic)]
        shared, longer = {}, np.zeros(len(grams.below[ORDER + 1]), bool)
        for length in range(ORDER, 0, -1):
            where, gram = grams.at[length]
            shared[length] = np.bincount(gram, n.sum(1)[grams.owner[where]], len(grams.own[length]))
            shared[length] = shared[length] + np.bincount(grams.below[length + 1], longer, len(grams.own[length]))
            longer = shared[length] > 0
        (p0, w0), (p1, w1) = (grams.likely(c, shared, letters) for c in counts)
        ratio = {k: np.log(p1[k] / p0[k]) for k in range(1, ORDER + 1)}
        if last:
            break
        total = np.zeros(grams.expressions)
        for length, (where, gram) in grams.at.items():
            total += np.bincount(grams.owner[where], ratio[length][gram], grams.expressions)
        odds = SHARE * np.exp(np.minimum(total, 50.0))
        toxic = np.rint(n[:, 1] * odds / (1 - SHARE + odds))
    kept = range(SHARED + 1, ORDER + 1)
    return Table(
        {k: (grams.own[k], ratio[k]) for k in kept},
        {k: (grams.contexts[k], np.log(w1[k] / w0[k])) for k in kept},
    )


@dataclass
class Model:
    """The class models' ratio table and the weights of the curve; without them all scores are 0."""

    letters: Letters | None = None
    table: Table | None = None
    curve: np.ndarray | None = None  # of (1, *evidence)

    def evidence(self, texts: Iterable[str | None], table: Table | None = None) -> np.ndarray:
        """Three columns by text: its log-likelihood ratio over the number of its expressions,
        over the root of that number, and the greatest of one expression."""
        number: dict[str, int] = {}
        own = [np.array([number.setdefault(w, len(number)) for w in set(words(t))], np.int64) for t in texts]
        each = mixed((table or self.table).of(self.letters, list(number)))
        out = np.zeros((len(own), 3))
        for i, x in enumerate(own):
            if len(x):
                ranked = np.sort(each[x])  # sets have no order, and sums depend on it
                out[i] = ranked.mean(), ranked.sum() / np.sqrt(len(x)), ranked[-1]
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.evidence(texts) @ self.curve[1:], -30, 30)))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, toxic, text)`` of the bounded sample."""
    ids = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic"))
    ids = ids.where("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64(F.lit("fit"), "id"), F.col("id")]
    toxic = ids.where("toxic = 1").orderBy(*order).limit(MAX_TOXIC)
    ordinary = ids.where("toxic = 0").orderBy(*order).limit(MAX_ORDINARY)
    chosen = F.broadcast(written(toxic.union(ordinary), "toxic-ids"))  # of bounded size
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(chosen, "id").where("text is not null").select("id", "toxic", "text")
    rows = rows.mapInArrow(_signed, f"{rows.schema.simpleString()[7:-1]}, s0 long, s1 long")
    for s in ("s0", "s1"):
        rows = rows.groupBy(s).agg(F.min_by(F.struct("id", "toxic", "text", "s1"), "id").alias("r")).select("r.*")
    return rows.drop("s1")


def _signed(batches):
    """The least hash of each text's three-word shingles, under two seeds."""
    for batch in pieces(batches):
        signs = ([], [])
        for text in batch.column(2).to_pylist():
            ws = words(text)
            shingles = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
            for seed, out in enumerate(signs):
                out.append(min(xxhash.xxh64_intdigest(x, seed) for x in shingles) >> 1)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *(pa.array(x, pa.int64()) for x in signs)], names=[*batch.schema.names, "s0", "s1"]
        )


def _counts(batches):
    """Texts by fold, class and expression."""
    for batch in pieces(batches):
        texts: dict[tuple[int, int, str], int] = {}
        for fold, c, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            for w in set(words(text)):
                texts[fold, c, w] = texts.get((fold, c, w), 0) + 1
        fold, c, w = zip(*texts) if texts else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(fold, pa.int32()), pa.array(c, pa.int32()), pa.array(w, pa.string()), pa.array(texts.values(), pa.int64())],
            names=["fold", "toxic", "w", "n"],
        )


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from ``labels`` (``id_col``, ``toxic`` 0 or 1) joined to ``docs``."""
    send_small(docs.sparkSession)
    fold = F.pmod(F.crc32(F.concat(F.lit("fold"), F.col("id").cast("string")).cast("binary")), F.lit(FOLDS)).cast("int")
    sample = written(_sample(docs, labels, id_col, text_col).select(fold.alias("fold"), "toxic", "text"), "toxic-sample")
    found = sample.mapInArrow(_counts, "fold int, toxic int, w string, n long").groupBy("w")
    cells = [(f, c) for f in range(FOLDS) for c in (0, 1)]
    found = found.agg(*[F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == c), F.col("n")).otherwise(0)).cast("int").alias(f"n{f}{c}") for f, c in cells])
    found = found.orderBy("w").toArrow()  # the words of a bounded sample
    expressions = found.column("w").to_pylist()
    n = np.array([found.column(f"n{f}{c}").to_numpy() for f, c in cells], float).reshape(FOLDS, 2, -1).transpose(0, 2, 1)
    del found
    if not n.any((0, 1)).all():
        return Model()
    points, times = np.unique(np.frombuffer("".join(expressions).encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
    letters = Letters(points[np.argsort(-times, kind="stable")][: (1 << _BITS) - 4].astype(np.int64))
    grams = Grams(letters, expressions)
    size = len(letters.points) + 2  # with the unknown letter and the end
    model = Model(letters, estimate(grams, n.sum(0), size))
    unseen = [estimate(grams, n.sum(0) - n[f], size) for f in range(FOLDS)]
    held = docs.sparkSession.sparkContext.broadcast((Model(letters), unseen))

    def evidence(batches):
        for batch in pieces(batches):
            bare, tables = held.value
            folds = batch.column(0).to_numpy()
            for f in np.unique(folds):
                part = batch.filter(pa.array(folds == f))
                own = bare.evidence(part.column(2).to_pylist(), tables[f])
                columns = [pa.array(own[:, k]) for k in range(3)]
                yield pa.RecordBatch.from_arrays([part.column(1), *columns], names=["toxic", "mean", "root", "top"])

    seen = sample.mapInArrow(evidence, "toxic int, mean double, root double, top double").toPandas()
    held.unpersist()
    seen = seen.sort_values(["toxic", "mean", "root", "top"])  # the sums of the curve don't depend on partitions
    model.curve = logistic(seen[["mean", "root", "top"]].to_numpy(), seen["toxic"].to_numpy())
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of (1, *x) by Newton's method, steps halved until they gain, with a ridge on
    those of the standardised x; both classes must occur."""
    mean, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    x = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    share = y.mean()
    each = np.where(y == 1, np.sqrt((1 - share) / share), 1.0)

    def loss(w):
        return (each * np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ w))).sum() + ridge / 2 * (w @ w)

    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (each * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (each * (y - p)) - ridge * w)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step /= 2
        w += step
        if np.abs(step).max() < 1e-9:
            break
    w[1:] /= scale
    w[0] -= w[1:] @ mean
    return w


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)``, one row per input row; the text alone is read."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches):
        for batch in pieces(batches):
            found = held.value.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "score"])

    send_small(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scores, f"doc_id {kind}, score double")


def keep_ordinary(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``THRESHOLD``, all columns as they were."""
    send_small(docs.sparkSession)
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def keep(batches):
        for batch in pieces(batches):
            yield batch.filter(pa.array(held.value.scores(batch.column(at).to_pylist()) < THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)


def learnable(id_col: str = "doc_id"):
    """Labels may be learnt from unless the id's checksum leaves remainder 1 by 3."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1
