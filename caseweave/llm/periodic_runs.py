"""Periodic runs of words within a text: seeds from repeated k-grams, extended along their diagonal once.

A run of period q has at least max(24, 3q) words, so at least max(24, 3q) - q words stand q after an equal word: 16 where
q <= 8 and 2q above. Grams of k = 16, 32, 64, ... words therefore meet every run with k/2 < q <= k (q <= 16 for k = 16),
and as k >= q, a gram inside a run is first seen again exactly one period later. So only neighbouring occurrences of a
gram are looked at, never all pairs, and each lag is the smallest period of what grows from it. Stretches of one lag are
extended once: a table of how far each lag is covered skips seeds inside what is known. All of it takes n log n time.
"""
from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS, LEAST_PERIODS, FIRST_GRAM = 24, 3, 16
#: Texts are looked at together up to about so many bytes.
GROUP_BYTES = 1 << 21
FOUND = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class Run(NamedTuple):
    start: int
    length: int
    period: int


class Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of pairs of 64-bit values."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def extent(words: np.ndarray, at: int, lag: int, low: int, high: int) -> tuple[int, int]:
    """The longest stretch [a, b) around ``at`` within [low, high - lag) where each word equals the one ``lag`` later."""
    end, step = at, 64
    while end < high - lag:
        size = min(step, high - lag - end)
        differs = np.flatnonzero(words[end:end + size] != words[end + lag:end + lag + size])
        if len(differs):
            end += int(differs[0])
            break
        end, step = end + size, 2 * step
    start, step = at, 64
    while start > low:
        size = min(step, start - low)
        differs = np.flatnonzero(words[start - size:start] != words[start - size + lag:start + lag])
        if len(differs):
            start = start - size + int(differs[-1]) + 1
            break
        start, step = start - size, 2 * step
    return start, end


def find_runs(words: np.ndarray, sizes: np.ndarray) -> list[list[Run]]:
    """The runs of several texts whose numbered words follow one another; sizes are their lengths in words."""
    ends = np.cumsum(sizes)
    found: list[list[Run]] = [[] for _ in sizes]
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    left = ends[text_of] - np.arange(len(words))  # words from here to the end of the text
    with np.errstate(over="ignore"):
        # hashes of the gram of k words at each place; those of different texts differ by the text's number
        gram = mixed(words.astype(np.uint64), text_of.astype(np.uint64))
        half, places = 1, np.arange(len(words))
        covered: dict[tuple[int, int], int] = {}
        k = 2
        while len(places):
            places = places[left[places] >= k]
            longer = np.zeros(len(words), dtype=np.uint64)
            longer[places] = mixed(gram[places], gram[places + half])
            gram, half = longer, k
            if k >= FIRST_GRAM:
                order = np.argsort(gram[places], kind="stable")
                seen = places[order]
                same = gram[seen[1:]] == gram[seen[:-1]]
                first, lag = seen[:-1][same], (seen[1:] - seen[:-1])[same]
                near = (lag <= k) & ((lag > k // 2) | (k == FIRST_GRAM))
                by = np.lexsort((first[near], lag[near]))
                first, lag = first[near][by], lag[near][by]
                # neighbouring seeds of one lag lie in one stretch
                heads = (np.diff(first, prepend=-2) != 1) | (np.diff(lag, prepend=0) != 0)
                for at, q in zip(first[heads].tolist(), lag[heads].tolist()):
                    text = int(text_of[at])
                    if at < covered.get((text, q), -1):
                        continue
                    a, b = extent(words, at, q, int(ends[text] - sizes[text]), int(ends[text]))
                    covered[text, q] = b
                    if b - a + q >= max(LEAST_WORDS, LEAST_PERIODS * q):
                        found[text].append(Run(a - int(ends[text] - sizes[text]), b - a + q, q))
                # a longer gram repeats only where both of its halves do
                twice = np.zeros(len(words), dtype=bool)
                twice[seen[1:][same]] = twice[seen[:-1][same]] = True
                places = np.flatnonzero(twice[:-k] & twice[k:])
            k *= 2
    return [sorted(set(runs), key=lambda r: (r.start, r.period)) for runs in found]


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run holds behind its first period, joined by one space."""
    if runs:
        kept = np.ones(len(words), dtype=bool)
        for run in runs:
            kept[run.start + run.period:run.start + run.length] = False
        words = [words[i] for i in np.flatnonzero(kept).tolist()]
    return b" ".join(words)


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The text that the query looks at: of a tenth of the documents, picked by doc_id, the words from some place on
    repeat with some period. A null doc_id is not picked."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * -(-(n - a) // p))[:n - a]


def periodic_runs(docs: DataFrame, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, runs (start, length, period in words; by start, then period) and collapsed text of every row of docs.

    ``rewrite`` may change the words of a text first. A null or empty text has no runs and collapses to the empty text; a
    null doc_id is kept; repeated rows are judged each time; a long text is looked at whole by the task that holds its
    row, alone, in n log n time; an empty table gives no rows. Other columns of docs are not read, so their names cannot
    clash. Nothing is shuffled.
    """
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, at = batch.column(0).to_pylist(), batch.column(1), 0
            while at < len(ids):
                size, end = 0, at
                while end < len(ids) and (end == at or size < GROUP_BYTES):
                    size += len(texts[end].as_buffer())
                    end += 1
                yield group(ids[at:end], texts[at:end].to_pylist())
                at = end

    def group(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        split = [text.split() for text in texts]
        if rewrite is not None:
            split = [rewrite(doc, words) for doc, words in zip(ids, split)]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        number = Numbers().__getitem__
        words = np.fromiter((code for some in split for code in map(number, some)), np.int64, int(sizes.sum()))
        runs = find_runs(words, sizes)
        kind = pa.list_(pa.struct([(name, pa.int64()) for name in Run._fields]))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([[r._asdict() for r in some] for some in runs], kind),
             pa.array([collapse(w, r) for w, r in zip(split, runs)], pa.binary()).cast(pa.string())],
            names=["doc_id", "runs", "collapsed"])

    return (docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
            .mapInArrow(found, FOUND))


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the run that repeats most often (exactly compared; of
    equals the first), nulls without a run, and the digests of all runs and of the collapsed text."""
    better = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    top = F.aggregate("runs", none, lambda a, r: F.when(better(a, r), r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"),
                                                                F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(lines, 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
