"""Language-model scores by a Brown class bigram model.

All training text is counted. Every word seen at least ``LEAST`` times there, the ``HEAD_WORDS``
most frequent of them, is assigned to a class: the ``CORE`` most frequent by the exchange
algorithm over their class-transition counts, all others in ``ROUNDS`` rounds, each word to the
class that the classes before and behind it in all training text speak for (the first order of
the exchange's gain). The number of classes grows with the root of the number of words. Rarer
and unknown words belong to a class of words of like length. A text's probability is the product
of smoothed class-transition and word-emission probabilities, with one end token per text.

``HEAD_WORDS`` bounds what is broadcast; it decides which words have a class of their own
context, not which are counted. Each word's neighbours are one list a task, shuffled once by the
word; a round is one pass over them. Counts of the other words travel as ``(text, word, count)``
rows and meet their total in a shuffled join, so nothing that grows with the corpus reaches the
driver but the head and the classes.

Nulls count as empty texts (one end token); repeated rows are scored one by one; without any
training text all counts are zero. Only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import written
from .batches import pieces, send_small

HEAD_WORDS = 262144
LEAST = 3
CORE = 1024
ROUNDS = 3
SHAPES = 8
ADD = 0.1
PULL = 4.0  # pseudo-count of the class unigrams in a transition
_FLUSH = 4_000_000  # different pairs of neighbours or words that a task holds
_MOST = 65535


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shape(word: bytes) -> int:
    return min(len(word) // 3, SHAPES - 1)


@dataclass
class Vocabulary:
    """Head words by frequency. A state is a head word, else one of the shapes of other words;
    the last state is the end of a text."""

    head: dict[bytes, int]
    n_states: int = field(init=False)

    def __post_init__(self):
        self.n_states = len(self.head) + SHAPES + 1

    def read(self, text: str | None) -> tuple[np.ndarray, list[bytes]]:
        """States, and the words that are not of the head."""
        ws, get = words(text), self.head.get
        states = np.array([get(w, -1) for w in ws], np.int64)
        at = np.flatnonzero(states < 0).tolist()
        rare = [ws[i] for i in at]
        states[at] = [len(self.head) + shape(w) for w in rare]
        return states, rare


def exchange(counts: np.ndarray, movable: int, classes: int, rounds: int = 8) -> np.ndarray:
    """Class of each state: the first ``movable`` move to the class that raises the mutual
    information of adjacent classes most, until a round moves none; the others stay alone."""
    n = len(counts)
    order = np.argsort(-counts[:movable].sum(1), kind="stable")
    of = np.empty(n, np.int64)
    of[order] = np.arange(movable) % classes
    of[movable:] = classes + np.arange(n - movable)
    k = classes + n - movable
    member = np.zeros((n, k))
    member[np.arange(n), of] = 1
    right, left = counts @ member, member.T @ counts  # state to class, class to state
    g = member.T @ right
    f = lambda x: x * np.log(np.maximum(x, 1e-12))
    for _ in range(rounds):
        moved = 0
        for w in order.tolist():
            was, own = of[w], counts[w, w]
            a, b = right[w].copy(), left[:, w].copy()
            a[was] -= own
            b[was] -= own
            g[was] -= a
            g[:, was] -= b
            g[was, was] -= own
            rows, cols = g.sum(1) + b, g.sum(0) + a  # as they'll be wherever the word goes
            corner = np.arange(k)
            gain = f(g + a).sum(1) - f(g).sum(1) + f(g.T + b).sum(1) - f(g.T).sum(1)
            diag = g[corner, corner]
            gain += f(diag + a + b + own) - f(diag) - (f(diag + a) - f(diag)) - (f(diag + b) - f(diag))
            gain -= f(rows + a.sum() + own) - f(rows) + f(cols + b.sum() + own) - f(cols)
            to = int(np.argmax(gain[:classes]))
            if gain[to] <= gain[was] + 1e-9:
                to = was
            g[to] += a
            g[:, to] += b
            g[to, to] += own
            if to != was:
                moved += 1
                of[w] = to
                right[:, was] -= counts[:, w]
                right[:, to] += counts[:, w]
                left[was] -= counts[w]
                left[to] += counts[w]
        if not moved:
            break
    return of


@dataclass
class Model:
    vocabulary: Vocabulary
    head_counts: np.ndarray
    train_texts: int
    train_tokens: int
    types: int
    classes: np.ndarray  # by state
    transition: np.ndarray  # log10, class to class
    emission: np.ndarray  # log10 by state; of the shapes without the word's own part

    def score(self, text: str | None) -> tuple[int, int, float, float]:
        """Tokens, known ones, base and model log10 probability, both without rare words'
        own part (the sum of log10(count + ADD) over them)."""
        states, _ = self.vocabulary.read(text)
        size = len(self.vocabulary.head)
        counts = self.head_counts[states[states < size]]
        n = len(states) + 1
        base = np.log10(counts + ADD).sum() + np.log10(self.train_texts + ADD)
        base -= n * np.log10(self.train_tokens + ADD * (self.types + 1))
        path = self.classes[np.concatenate(([-1], states, [-1]))]
        model = self.transition[path[:-1], path[1:]].sum() + self.emission[states].sum()
        return n, len(counts) + (self.train_texts > 0), float(base), float(model)


def _word_counts(batches):
    """Words and their number, some at a time."""

    def rows(seen):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"]
        )

    seen: Counter[bytes] = Counter()
    for batch in pieces(batches):
        for text in batch.column(0).to_pylist():
            seen.update(words(text))
        if len(seen) > _FLUSH // 8:
            yield rows(seen)
            seen = Counter()
    yield rows(seen)


def _blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Runs of ``values`` as binary values: copied whole, where lists would go one by one."""
    offsets = pa.py_buffer((cuts * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, offsets, pa.py_buffer(values)])


def _runs(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """Values of a binary column, and where each row's begin and end."""
    _, offsets, data = column.buffers()
    cuts = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size = np.dtype(kind).itemsize
    values = np.frombuffer(data.slice(int(cuts[0]), int(cuts[-1] - cuts[0])), kind) if data is not None else np.empty(0, kind)
    return values, (cuts - cuts[0]) // size


def _tally(held):
    """Rows with a ``state``: its neighbours behind it (``after``) or before it and how often
    they are. Rows with a ``key``: a rare word and its count in that text; without a word, a
    mark for each text."""
    names = ["state", "after", "near", "times", "key", "word", "n"]
    kinds = [pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int64()]

    def lists(pairs, size):
        codes, times = pairs
        again = -(-times // _MOST)  # counts are kept in two bytes: larger ones are several
        at = np.repeat(np.arange(len(codes)), again)
        rest = times[at] - _MOST * (np.arange(len(at)) - np.repeat(np.cumsum(again) - again, again))
        codes, times = codes[at], np.minimum(rest, _MOST)
        for after in (True, False):
            own, near = codes // size, codes % size
            if not after:
                order = np.argsort(near, kind="stable")
                own, near, times = near[order], own[order], times[order]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            cuts = np.append(first, len(own))
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[first], kinds[0]), pa.array(np.full(len(first), after))]
                + [_blobs(near.astype(np.int32), cuts), _blobs(times.astype(np.uint16), cuts)]
                + [pa.nulls(len(first), k) for k in kinds[4:]],
                names=names,
            )

    def run(batches):
        vocabulary: Vocabulary = held.value
        size = vocabulary.n_states
        fresh, waiting = [], 0
        pairs = np.empty(0, np.int64), np.empty(0, np.int64)

        def merged():
            codes, times = np.unique(np.concatenate([*fresh, np.empty(0, np.int64)]), return_counts=True)
            both, at = np.unique(np.concatenate((pairs[0], codes)), return_inverse=True)
            return both, np.bincount(at, np.concatenate((pairs[1], times)), len(both)).astype(np.int64)

        for batch in pieces(batches):
            keys, ws, ns = [], [], []
            for key, text, train in zip(*(c.to_pylist() for c in batch.columns)):
                states, rare = vocabulary.read(text)
                if train:
                    path = np.concatenate(([size - 1], states, [size - 1]))
                    fresh.append(path[:-1] * size + path[1:])
                    waiting += len(path)
                times = Counter(rare)
                ws.append(None)
                ws.extend(times)
                ns.append(1)
                ns.extend(times.values())
                keys.extend([key] * (len(times) + 1))
            columns = [pa.array(keys, kinds[4]), pa.array(ws, kinds[5]), pa.array(ns, kinds[6])]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(keys), k) for k in kinds[:4]), *columns], names=names)
            if waiting > _FLUSH // 4:
                pairs, fresh, waiting = merged(), [], 0
                if len(pairs[0]) > _FLUSH:
                    yield from lists(pairs, size)
                    pairs = np.empty(0, np.int64), np.empty(0, np.int64)
        yield from lists(merged(), size)

    return run


def _joined(batches):
    """Rows in the order of (``state``, ``after``): one row for each, the lists one behind another."""
    for batch in batches:
        state, after = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        if not len(state):
            continue
        first = np.flatnonzero(np.append(True, (state[1:] != state[:-1]) | (after[1:] != after[:-1])))
        joined = []
        for k, kind in ((2, np.int32), (3, np.uint16)):
            values, cuts = _runs(batch.column(k), kind)
            joined.append(_blobs(values, np.append(cuts[first], cuts[-1])))
        yield pa.RecordBatch.from_arrays([pa.array(state[first]), pa.array(after[first]), *joined], names=batch.schema.names)


def _by_class(held, result):
    """One round over some states' neighbours: ``result`` of the states, and of how often each
    class stands before (row 0) and behind (row 1) them."""

    def run(batches):
        classes = held.value
        k = int(classes.max()) + 1
        number: dict[int, int] = {}
        sums = np.zeros((0, 2 * k))
        for batch in pieces(batches, 20000):
            state, after = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            near, cuts = _runs(batch.column(2), np.int32)
            times, _ = _runs(batch.column(3), np.uint16)
            own = np.array([number.setdefault(x, len(number)) for x in state.to_pylist()], np.int64)
            if len(number) > len(sums):
                sums = np.concatenate((sums, np.zeros((max(len(sums), len(number) - len(sums), 256), 2 * k))))
            used, at = np.unique(own, return_inverse=True)
            cell = np.repeat((at * 2 + after) * k, np.diff(cuts)) + classes[near]
            sums[used] += np.bincount(cell, times, len(used) * 2 * k).reshape(-1, 2 * k)
        yield from result(np.array(list(number), np.int64), sums[: len(number)].reshape(-1, 2, k))

    return run


def _gathered(contexts: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Transitions from class to class."""
    k = int(classes.max()) + 1
    held = contexts.sparkSession.sparkContext.broadcast(classes)

    def result(states, sums):
        own = np.zeros((k, k))
        np.add.at(own, held.value[states], sums[:, 1])
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own.ravel()[at].astype(np.int64))], names=["cell", "n"])

    cells = contexts.where("after").mapInArrow(_by_class(held, result), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = cells.toPandas()  # classes by classes
    held.unpersist()
    out = np.zeros(k * k)
    out[found["cell"].to_numpy(np.int64)] = found["n"]
    return out.reshape(k, k)


def _assigned(contexts: DataFrame, classes: np.ndarray, movable: range, n_classes: int) -> np.ndarray:
    """Classes after each of the ``movable`` states went where its neighbours' classes are
    likeliest to be neighbours (ties: the lower class)."""
    between = _gathered(contexts, classes) + ADD
    behind = np.log(between / between.sum(1, keepdims=True))[:n_classes]  # class behind, by class
    before = np.log(between / between.sum(0, keepdims=True))[:, :n_classes].T
    held = contexts.sparkSession.sparkContext.broadcast(classes)

    def result(states, sums):
        best = np.argmax(sums[:, 0] @ before.T + sums[:, 1] @ behind.T, axis=1) if len(states) else states
        yield pa.RecordBatch.from_arrays([pa.array(states), pa.array(best, pa.int64())], names=["state", "class"])

    wanted = contexts.where(F.col("state").between(movable.start, movable.stop - 1))
    found = wanted.mapInArrow(_by_class(held, result), "state long, class long").toPandas()  # head words at most
    held.unpersist()
    out = classes.copy()
    out[found["state"].to_numpy(np.int64)] = found["class"]
    return out


def n_classes(head: int) -> int:
    return max(1, min(head, round(math.sqrt(head) / 4) + 8))


def cluster(contexts: DataFrame, head: int) -> np.ndarray:
    """Class of each state: head words share ``n_classes``, shapes and the end stay alone."""
    k, core, size = n_classes(head), min(CORE, head), head + SHAPES + 1
    start = np.concatenate((np.arange(core), core + np.arange(size - head)))  # core words alone
    place = np.full(size, len(start))  # words that are not exchanged: one further class
    place[np.concatenate((np.arange(core), np.arange(head, size)))] = start
    own = contexts.where((F.col("state") < core) | (F.col("state") >= head))
    counts = _gathered(own, place)[: len(start), : len(start)]
    of = exchange(counts, core, k)
    classes = np.empty(size, np.int64)
    classes[:core], classes[head:] = of[:core], k + np.arange(SHAPES + 1)
    classes[core:head] = k + SHAPES + 1  # one class of its own, as long as nothing is known
    if head > core:
        for _ in range(ROUNDS):
            classes = _assigned(contexts, classes, range(core, head), k)
    return classes


def fit(rows: DataFrame) -> tuple[Model, DataFrame]:
    """``rows``: ``key`` (long), ``text``, ``train``. The model, and by key what the rare words
    of its texts add: ``rare_sum``, ``rare_known`` and ``texts`` (rows with that key)."""
    spark = rows.sparkSession
    counts = rows.where("train").select("text").mapInArrow(_word_counts, "word binary, n long")
    counts = written(counts.groupBy("word").agg(F.sum("n").alias("c")), "lm-words")
    top = counts.where(F.col("c") >= LEAST).orderBy(F.desc("c"), "word").limit(HEAD_WORDS).toArrow()
    vocabulary = Vocabulary({w: i for i, w in enumerate(top.column("word").to_pylist())})
    head, heads = len(vocabulary.head), top.column("c").to_numpy()

    held = spark.sparkContext.broadcast(vocabulary)
    kinds = "state int, after boolean, near binary, times binary, key long, word binary, n long"
    tally = written(rows.mapInArrow(_tally(held), kinds), "lm-tally")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    contexts = tally.where("state is not null").select("state", "after", "near", "times")
    # the lists of a word that moves meet in one part; those of the most frequent needn't and are spread
    spread = F.when((F.col("state") < CORE) | (F.col("state") >= head), F.pmod(F.monotonically_increasing_id(), F.lit(parts))).otherwise(0)
    contexts = contexts.repartition(parts, F.col("state"), spread).sortWithinPartitions("state", "after")
    contexts = written(contexts.mapInArrow(_joined, contexts.schema), "lm-contexts")
    classes = cluster(contexts, head)

    length = F.least(F.floor(F.octet_length("word") / 3), F.lit(SHAPES - 1)).cast("int")
    sizes = np.zeros((SHAPES, 2))  # of words of each shape outside the head: types and tokens
    for r in counts.groupBy(length.alias("s")).agg(F.count("*").alias("types"), F.sum("c").alias("tokens")).collect():
        sizes[r["s"]] = r["types"], r["tokens"]
    for w, c in zip(vocabulary.head, heads.tolist()):
        sizes[shape(w)] -= 1, c

    tail = tally.where("key is not null").select("key", "word", "n")
    part = tail.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0))).groupBy("key").agg(
        F.sum(F.when(F.col("word").isNotNull(), F.col("n") * F.log10(F.col("c") + F.lit(ADD)))).alias("rare_sum"),
        F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("rare_known"),
        F.count_if(F.col("word").isNull()).alias("texts"),
    )

    between = _gathered(contexts, classes)
    k = len(between)
    first = (between.sum(0) + ADD) / (between.sum() + ADD * k)
    step = (between + PULL * first) / (between.sum(1, keepdims=True) + PULL)
    tokens = np.bincount(classes[:head], heads, k) if head else np.zeros(k)
    members = np.bincount(classes[:head], minlength=k).astype(float)
    shapes = classes[head : head + SHAPES]
    tokens[shapes] += sizes[:, 1]
    members[shapes] += sizes[:, 0] + 1  # any unknown word
    total = np.log10(np.maximum(tokens + ADD * members, ADD))
    emission = np.concatenate((np.log10(heads + ADD) - total[classes[:head]], -total[shapes]))
    texts = int(between[:, classes[-1]].sum())
    seen = heads.sum() + sizes[:, 1].sum()
    model = Model(
        vocabulary, heads, texts, int(seen) + texts, int(head + sizes[:, 0].sum()) + (texts > 0), classes, np.log10(step), emission
    )
    return model, part


def score(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity)`` of every
    row; ``train`` is the boolean column that marks the rows to learn from. Scores are log10
    probabilities of the whole text."""
    send_small(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"),
        F.col(text_col).cast("string").alias("text"),
        F.coalesce(train, F.lit(False)).alias("train"),
    )
    model, part = fit(rows.select("key", "text", "train"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches):
        for batch in pieces(batches):
            found = list(zip(*map(held.value.score, batch.column(2).to_pylist()))) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(v, t) for v, t in zip(found, kinds))],
                names=["doc_id", "key", "n_tokens", "n_known", "base_score", "score"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    local = rows.select("doc_id", "key", "text").mapInArrow(
        scores, f"doc_id {kind}, key long, n_tokens long, n_known long, base_score double, score double"
    )
    more = F.coalesce(F.col("rare_sum") / F.col("texts"), F.lit(0.0))
    known = F.coalesce((F.col("rare_known") / F.col("texts")).cast("long"), F.lit(0))
    out = local.join(part, "key", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + known).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
