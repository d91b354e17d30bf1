"""SimHash near-duplicates found by deletion-variant signatures."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.llm.common import components, cut, fresh, text_key

#: First bits and widths of the three segments: of at most four differing bits, one segment has at most one.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
LIMIT = 4
SMALL = 12


def fingerprint(text: bytes, words: int = 4) -> int:
    """The 64-bit majority of the XXH64 hashes (seed 42) of all shingles of `words` words, as a signed number.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased, joined by one blank. A text of fewer
    words is one shingle; a text without words has fingerprint 0.
    """
    from xxhash import xxh64_digest
    found = text.lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[k:] for k in range(words))))
    digests = b"".join([xxh64_digest(s, 42) for s in shingles])
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    over = bits.sum(axis=0, dtype=np.int64) * 2 > len(bits)
    return int.from_bytes(np.packbits(over).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 4, *more: Column) -> DataFrame:
    """(doc_id, fp) and `more` of every row; a null text counts as empty. Whole texts are read, none is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64()), *batch.columns[2:]],
                                             names=["doc_id", "fp", *batch.schema.names[2:]])
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), *more)
    return rows.mapInArrow(run, ", ".join(["doc_id long", "fp long", *(f"{n} {t}" for n, t in rows.dtypes[2:])]))


def variants(prints: DataFrame) -> DataFrame:
    """(key, fp): every distinct fingerprint under 64 keys, one for each bit: its segment with that bit left out."""
    keys = []
    for first, width in SEGMENTS:
        for bit in range(width):
            mask = ((1 << width) - 1) & ~(1 << bit)
            keys.append(F.shiftrightunsigned("fp", first).bitwiseAND(F.lit(mask)).bitwiseOR(F.lit((first + bit) << 22)))
    return prints.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= LIMIT


def _forest(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same fingerprints as all links of one bucket do: a search that meets each one once."""
    src, dst = [], []
    rest = fp
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = _near(rest, at)
            if near.any():
                hits = rest[near]
                src.append(np.full(len(hits), at))
                dst.append(hits)
                queue.extend(hits)
                rest = rest[~near]
    return (np.concatenate(src), np.concatenate(dst)) if src else (fp[:0], fp[:0])


def _bucket_links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within the buckets of sorted keys. Small buckets are compared pair by pair for all at once."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    src, dst = [], []
    few = np.repeat((size > 1) & (size <= SMALL), size)
    k, f = key[few], fp[few]
    for step in range(1, SMALL):
        if len(k) <= step:
            break
        same = k[step:] == k[:-step]
        if not same.any():
            break
        a, b = f[:-step][same], f[step:][same]
        near = _near(a, b)
        src.append(a[near])
        dst.append(b[near])
    for at in np.flatnonzero(size > SMALL):
        a, b = _forest(fp[start[at]:start[at] + size[at]])
        src.append(a)
        dst.append(b)
    if not src:
        return fp[:0], fp[:0]
    pairs = np.unique(np.stack([np.concatenate(src), np.concatenate(dst)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def links(prints: DataFrame) -> DataFrame:
    """(src, dst) links of distinct fingerprints that differ in at most four bits: enough to join all that are linked.

    Fingerprints meet in the buckets of variants() and every link is verified on all 64 bits. Buckets of up to 12 give
    all their links; larger ones a spanning forest of them, never all pairs. A bucket holds distinct fingerprints that
    share 20 bits; it is 8 bytes each in its task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: list[np.ndarray], fp: list[np.ndarray]) -> pa.RecordBatch:
            a, b = _bucket_links(np.concatenate(key), np.concatenate(fp))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["src", "dst"])

        keys, prints_ = [], []
        for batch in batches:
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield out([*keys, key[:last]], [*prints_, fp[:last]])
                keys, prints_ = [key[last:]], [fp[last:]]
            elif keys and keys[-1][-1] != key[0]:
                yield out(keys, prints_)
                keys, prints_ = [key], [fp]
            else:
                keys.append(key)
                prints_.append(fp)
        if keys:
            yield out(keys, prints_)

    dealt = variants(prints).repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(run, "src long, dst long").distinct()


def _groups(found: DataFrame) -> DataFrame:
    """(of, component, component_id) of every distinct fingerprint of found: the fingerprint that names its component,
    also where no doc_id does, and the component's smallest doc_id."""
    distinct = cut(found.groupBy("fp").agg(F.min("doc_id").alias("low")))
    joined = components(links(distinct.select("fp")))
    grouped = distinct.join(joined, distinct["fp"] == joined["node"], "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("component"))
    low = grouped.groupBy("component").agg(F.min("low").alias("component_id"))
    return cut(grouped.join(low, "component").select(F.col("fp").alias("of"), "component", "component_id"))


def near_duplicates(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp, fingerprint as 16 hex digits, component_id) of every row.

    Fingerprints link at four or fewer differing bits, also the zero of empty texts; component_id is the smallest doc_id
    reachable over links. Only one row per distinct fingerprint is compared, so equal texts cost nothing. Rows that
    repeat a doc_id each come back; a null doc_id takes part, and is the component_id only where a component has no
    other. Other columns are not read. An empty table gives no rows.
    """
    found = cut(fingerprints(docs, words))
    named = _groups(found)
    return found.join(named, found["fp"] == named["of"]).select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 4) -> DataFrame:
    """docs without near-duplicates: of each component one row stays, columns unchanged.

    It is the row of the smallest doc_id, of several with that doc_id the one of the smallest text hash; rows with a
    null doc_id come last, so one of them stays only if nothing else is in its component. Components are told apart by
    fingerprints: a doc_id that repeats, or is null, in several of them has a row in each. Of rows equal in doc_id and
    text any one stays.
    """
    own_id, own_key = fresh(docs, "__keep_id", "__keep_key")
    found = cut(fingerprints(docs, words, text_key(F.col("text")).alias("text_key")))
    named = _groups(found)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")).alias("first")
    per_print = found.groupBy("fp").agg(first)
    keep = cut(per_print.join(named, per_print["fp"] == named["of"]).groupBy("component").agg(F.min("first").alias("first"))
               .select(F.col("first.doc_id").alias(own_id), F.col("first.text_key").alias(own_key)))
    joined = docs.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (text_key(F.col("text")) == F.col(own_key)))
    return joined.dropDuplicates([own_id, own_key]).select(*docs.columns)
