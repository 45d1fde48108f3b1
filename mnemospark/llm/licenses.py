"""License scan: Aho-Corasick over identifier tags and notice phrases, and a shunting-yard
parser that evaluates AND / OR / WITH licence expressions behind an identifier tag.

Words are runs of lower-cased letters, digits and non-ASCII bytes; a phrase is found where its
words stand consecutively. Nulls count as empty texts; an empty text has no words and score 0.
Every row yields one row, repeated rows included; only the id and text columns are read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import pieces, send_small

# The phrases every scan counts, with their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notice phrases of this method, with their labels.
NOTICE_PHRASES = {
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "mozilla public license": "mpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "eclipse public license": "epl",
    "all rights reserved": "proprietary",
}
# Licence identifiers by label; a version, "+", "-only" and "-or-later" may follow those marked *.
IDENTIFIERS = {
    "agpl": "agpl*", "lgpl": "lgpl*", "gpl": "gpl*", "apache": "apache*", "mit": "mit mit-0", "mpl": "mpl*", "epl": "epl*",
    "bsd": "bsd 0bsd bsd-1-clause bsd-2-clause bsd-3-clause bsd-4-clause bsd-2-clause-patent bsd-3-clause-clear",
    "cc-by-nc": "cc-by-nc* cc-by-nc-sa* cc-by-nc-nd*", "cc-by-sa": "cc-by-sa*", "cc-by-nd": "cc-by-nd*", "cc-by": "cc-by*",
    "cc0": "cc0*", "isc": "isc", "unlicense": "unlicense", "zlib": "zlib",
}
_EXACT = {name: label for label, names in IDENTIFIERS.items() for name in names.replace("*", "").split()}
_SERIES = {name[:-1] for names in IDENTIFIERS.values() for name in names.split() if name.endswith("*")}
_VERSION = re.compile(r"-v?[0-9]+(?:\.[0-9]+)*(?:-only|-or-later|\+)?")


def label_of(identifier: str) -> str | None:
    """Label of a lower-cased licence identifier; None if it's not a known one."""
    label = _EXACT.get(identifier)
    at = _VERSION.search(identifier)
    if not label and at and at.end() == len(identifier) and identifier[: at.start()] in _SERIES:
        label = _EXACT[identifier[: at.start()]]
    return label


# How freely a licence lets a text be used again: 1 freely, 0 not at all; unknown ones 0.
FREEDOM = {
    "apache": 1.0, "mit": 1.0, "bsd": 1.0, "isc": 1.0, "unlicense": 1.0, "zlib": 1.0, "cc0": 1.0,
    "cc-by": 0.9, "mpl": 0.6, "epl": 0.6, "lgpl": 0.6, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3,
    "cc-by-nd": 0.2, "cc-by-nc": 0.1, "proprietary": 0.0,
}
TAG = "spdx license identifier"
_TAG_LINE = re.compile(rb"spdx-license-identifier:[ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"[()]|[a-z0-9.+-]+")
_BIND = {"or": 1, "and": 2, "with": 3}
#: Every ASCII byte that is no letter or digit becomes a space; non-ASCII bytes stay.
_WORD_BYTES = bytes(
    b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256)
)

FIELDS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, expressions array<string>, freedom double"
)


def to_postfix(expression: str) -> list[str] | None:
    """Shunting yard: WITH binds before AND before OR; None if the expression is malformed.
    Text behind a complete expression (a comment's end) is ignored."""
    out, stack, operand = [], [], True
    for token in _TOKEN.findall(expression.lower()):
        if token == "(":
            if not operand:
                break
            stack.append(token)
        elif token == ")":
            if operand or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif token in _BIND:
            if operand:
                return None
            while stack and stack[-1] != "(" and _BIND[stack[-1]] >= _BIND[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = True
        elif not operand:
            break
        else:
            out.append(token)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """Labels named by an expression, and its freedom: OR lets one choose (largest), AND binds
    to both (smallest), WITH keeps that of the licence it modifies."""
    stack: list[tuple[set[str], float]] = []
    for token in postfix:
        if token in _BIND:
            (right, low), (left, high) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((left, high))
            else:
                stack.append((left | right, (max if token == "or" else min)(low, high)))
        else:
            label = label_of(token) or "other"
            stack.append(({label}, FREEDOM.get(label, 0.0)))
    return stack[0]


def known(postfix: list[str]) -> bool:
    """Whether every licence an expression names is a known one; what WITH adds is an exception
    to a licence and any name will do."""
    stack: list[bool] = []
    for token in postfix:
        if token in _BIND:
            right, left = stack.pop(), stack.pop()
            stack.append(left if token == "with" else left and right)
        else:
            stack.append(label_of(token) is not None)
    return stack[0]


@lru_cache(None)
def _automaton():
    found = ahocorasick.Automaton()
    for phrase in {*BASE_PHRASES, *NOTICE_PHRASES, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: str | None) -> tuple:
    """The values of ``FIELDS`` for one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(_WORD_BYTES).split()
    line = f" {b' '.join(words).decode('latin-1')} "
    base, first, last, base_labels, labels, expressions, tagged, valid = 0, None, None, set(), set(), [], False, False
    at, seen = 0, 0
    for end, phrase in _automaton().iter(line):
        if phrase == TAG:
            tagged = True
            continue
        label = BASE_PHRASES.get(phrase) or NOTICE_PHRASES[phrase]
        labels.add(label)
        if phrase in BASE_PHRASES:
            start = end - len(phrase) - 1
            # matches come by their end, so a longer phrase may begin before the last one
            seen += line.count(" ", at, start) if start >= at else -line.count(" ", start, at)
            at = start
            base += 1
            base_labels.add(label)
            first = seen if first is None else min(first, seen)
            last = seen if last is None else max(last, seen)
    free = [FREEDOM.get(x, 0.0) for x in labels]
    if tagged:
        for found in _TAG_LINE.findall(raw.lower()):
            postfix = to_postfix(found.decode("utf-8", "replace"))
            if postfix and any(label_of(x) for x in postfix):
                named, freedom = evaluate(postfix)
                labels |= named
                free.append(freedom)
                expressions.append(" ".join(postfix))
                valid |= known(postfix)
    score = 1.0 if valid else 1 - 0.2 / (1 + base) if base else 0.6 if labels else 0.0
    joined = lambda x: ",".join(sorted(x))
    return len(words), base, first, last, joined(base_labels), joined(labels), score, expressions, min(free, default=None)


def _scans(batches):
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string()), pa.float64()]
    names = ["id", *(x.split()[0] for x in FIELDS.split(", "))]
    for batch in pieces(batches):
        rows = list(zip(*map(scan, batch.column(1).to_pylist()))) or [[]] * len(kinds)
        columns = [pa.array(v, k) for v, k in zip(rows, kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: word and base counts, labels, a score from 0 (no sign of a
    licence) to 1 (a valid expression of known licences; words behind a tag that name none are no
    expression), the expressions found in postfix order, and
    ``freedom``, that of the strictest licence found (null: none found)."""
    send_small(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scans, f"id {kind}, {FIELDS}").withColumnRenamed("id", id_col)
