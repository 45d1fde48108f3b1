"""Packing by shortest-pack-first over the length histogram.

Documents become token pieces of at most ``width`` ids; the histogram of piece lengths (at
most ``width`` entries) is all the driver sees. It places lengths longest first, each into the
emptiest pack group it fits, a group being a run of packs of equal fill. Every placement is an
interval of ranks within one length, so pieces find sequence and offset by joining their rank
to the intervals; their number depends on ``width``, not on the corpus.

Nulls and empty texts are the end id alone. Repeated rows and null ids are packed like any
other row. Only the id and text columns are read.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import gapless_rank, written
from .batches import pieces as small, send_small

WIDTH = 1024
END_ID = 0
#: Texts of these characters alone take the faster encoder, whose ids there are the same.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ]")
_BYTE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(None)
def _exact(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(None)
def _quick(path: str):
    """The same ranks in the faster encoder and the texts of special tokens; None where the
    file's rules are others than that encoder's (byte-level pieces, merges in the order of ids)."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {x["content"] for x in spec.get("added_tokens", ())}
    if not _is_plain(spec):
        return None
    # bytes as that vocabulary writes them: printable ones as themselves, others from U+0100 on
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
    ranks = {bytes(byte_of[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in added}
    return tiktoken.Encoding("piece", pat_str=_BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={}), added


def _is_plain(spec: dict) -> bool:
    before, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    if spec.get("normalizer") or model.get("type", "BPE") != "BPE":
        return False
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or before.get("use_regex") is False:
        return False
    odd = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
    ids = [model["vocab"].get("".join(m), -1) for m in merges]
    return not any(model.get(x) for x in odd) and all(a < b for a, b in zip([-1, *ids], ids))


def encode(texts: list[str | None], path: str) -> list[np.ndarray]:
    """Ids of each text by the tokenizer file at ``path`` (byte-level BPE), then ``END_ID``."""
    quick, added = _quick(path) or (None, ())
    out = []
    for text in texts:
        text = text or ""
        if not quick or _PLAIN.search(text) or any(x in text for x in added):
            ids = _exact(path).encode(text, add_special_tokens=False).ids
        else:
            ids = quick.encode_ordinary(text)
        ids.append(END_ID)
        out.append(np.array(ids, "<u4"))
    return out


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens)``: each document cut every ``width`` ids."""

    def cut(batches):
        for batch in small(batches):
            ids = encode(batch.column(1).to_pylist(), path)
            rows = [
                (n, s, min(width, len(x) - s), zlib.crc32(x[s : s + width].tobytes()), len(x))
                for n, x in enumerate(ids)
                for s in range(0, len(x), width)
            ]
            n, *columns = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(n, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    send_small(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def plan(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[int, int, int, int, int]]:
    """Placements ``(length, first rank, count, first sequence, offset)``; ranks count the
    pieces of one length from 0. Pack groups of equal fill are runs of sequences."""
    groups: dict[int, list[tuple[int, int]]] = {}
    placed, opened = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            fill = min((f for f in groups if f + length <= width), default=None)
            if fill is None:
                whole = left // (width // length)
                for n, copies in ((whole, width // length), (bool(left % (width // length)), left % (width // length))):
                    for k in range(copies if n else 0):
                        placed.append((length, rank, n, opened, k * length))
                        rank += n
                    if n:
                        groups.setdefault(copies * length, []).append((opened, n))
                        opened += n
                break
            first, n = groups[fill].pop()
            if not groups[fill]:
                del groups[fill]
            used = min(n, left)
            placed.append((length, rank, used, first, fill))
            groups.setdefault(fill + length, []).append((first, used))
            if used < n:
                groups.setdefault(fill, []).append((first + used, n - used))
            rank, left = rank + used, left - used
    return placed


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; sequences are gapless from offset 0."""
    cut = written(pieces(docs, path, id_col, text_col, width), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    before, placed = {}, 0
    for length in sorted(histogram):
        before[length], placed = placed, placed + histogram[length]
    spans = [(l, before[l] + r, before[l] + r + n, s, o) for l, r, n, s, o in plan(histogram, width)]
    spans = docs.sparkSession.createDataFrame(spans, "length long, low long, high long, first long, offset long")
    order = [F.col(c).asc() for c in ("length", "doc_id", "start", "ids_crc32", "doc_tokens")]
    ranked = gapless_rank(cut, order, "rank").alias("p")
    found = ranked.join(F.broadcast(spans.alias("s")), F.expr("p.length = s.length and rank >= low and rank < high"))
    sequence = (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id")
    return found.select("doc_id", "start", "p.length", "ids_crc32", "doc_tokens", sequence, "offset")
