"""Best-fit packing of token sequences, planned on the histogram of lengths."""
from __future__ import annotations

import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm.common import cut

CACHE_WORDS, CACHE_BYTES = 600_000, 48
_loaded: dict[str, WordEncoder] = {}


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, the others for
    the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


class WordEncoder:
    """Token ids of a text, as little-endian uint32 bytes, from a tokenizer that lower-cases, drops white space and never
    joins letters with other signs.

    Words (runs without ASCII white space) are encoded once and remembered; the memory is cleared when it is full. A
    word's trailing ASCII signs are a token run of their own. Words of Latin letters only are one piece to the model;
    every other word goes through the tokenizer's whole chain.
    """

    SIGNS = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))

    def __init__(self, tokenizer_json: str) -> None:
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}

    def _split(self, word: bytes) -> tuple[bytes, ...]:
        core = word.rstrip(self.SIGNS)
        if len(core) < len(word) and core and core[-1:].isalnum() and b"<|" not in word:
            return core, word[len(core):]
        return (word,)

    def _letters_of(self, part: bytes) -> str | None:
        """What the model reads for a part of Latin letters only; None for others."""
        if part.isalpha():
            return part.lower().decode("ascii")
        text = part.decode("utf-8", "replace")
        if max(text) < "\u0250" and text.isalpha():
            text = text.lower()
            if text.isalpha() and unicodedata.is_normalized("NFC", text):
                return "".join([self.letters[b] for b in text.encode()])
        return None

    def _learn(self, missing: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words that are not known yet."""
        if len(self.parts) > CACHE_WORDS // 2:
            self.parts.clear()
        split = {word: self._split(word) for word in missing}
        found, hard = self.parts, []
        for part in {p for parts in split.values() for p in parts if p not in found}:
            letters = self._letters_of(part)
            if letters is None:
                hard.append(part)
            else:
                found[part] = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        for at in range(0, len(hard), 10_000):
            part = hard[at:at + 10_000]
            texts = [w.decode("utf-8", "replace") for w in part]
            for word, enc in zip(part, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                found[word] = array("I", enc.ids).tobytes()
        out = {word: b"".join([found[p] for p in parts]) for word, parts in split.items()}
        for part in {p for parts in split.values() for p in parts if len(p) > CACHE_BYTES}:
            del found[part]
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        # lower-casing A-Z first halves the words to remember; special tokens are written in lower case only
        split = [(text if b"<|" in text else text.lower()).split() for text in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        missing = {word for words in split for word in words if word not in known}
        new = self._learn(missing)
        long = {w: ids for w, ids in new.items() if len(w) > CACHE_BYTES}
        known.update((w, ids) for w, ids in new.items() if len(w) <= CACHE_BYTES)
        if long:
            return [b"".join([known[w] if w in known else long[w] for w in words]) for words in split]
        return [b"".join([known[w] for w in words]) for words in split]


def encoder(shared) -> WordEncoder:
    """The encoder of a broadcast tokenizer file, kept once per Python worker."""
    if shared.id not in _loaded:
        _loaded.clear()
        _loaded[shared.id] = WordEncoder(shared.value)
    return _loaded[shared.id]


class SharedTokenizer:
    """A tokenizer file read on the driver and broadcast: its size is that of the file, whatever the data."""

    def __init__(self, spark, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            self.handle = spark.sparkContext.broadcast(file.read())
        self.id = uuid.uuid4().hex

    @property
    def value(self) -> str:
        return self.handle.value


def token_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the ids of each text and one end id, cut into max_tokens ids at most.

    A null text counts as empty (its piece is the end id alone). Repeated doc_ids give their pieces each time.
    """
    shared = SharedTokenizer(docs.sparkSession, tokenizer_path)
    end = np.array([end_id], dtype="<u4").tobytes()
    width = 4 * max_tokens

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                rows = []
                for doc, found in zip(ids, coder.encode(texts)):
                    found += end
                    for n, start in enumerate(range(0, len(found), width)):
                        piece = found[start:start + width]
                        rows.append((doc, n, start // 4, len(piece) // 4, zlib.crc32(piece)))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return (docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
            .mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long"))


def plan_best_fit(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over counts of lengths: rows (length, rank from, count, first sequence, per sequence, offset).

    Sequences with the same content are one range of ids, so placing a length costs one step per range and not per
    item: a range is revisited only after its free room has at least halved, which bounds the plan by about
    33 x capacity rows whatever the number of items.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    mask, following, slots = 0, 0, []

    def put(free: int, first: int, count: int) -> None:
        nonlocal mask
        if free and count:
            room.setdefault(free, []).append((first, count))
            mask |= 1 << free

    for length in sorted(histogram, reverse=True):
        rank, rest = 0, histogram[length]
        while rest:
            fits = mask >> length
            if fits:
                free = length + (fits & -fits).bit_length() - 1
                first, count = room[free].pop()
                if not room[free]:
                    mask &= ~(1 << free)
            else:
                free, first, count = capacity, following, -(-rest // (capacity // length))
                following += count
            each = free // length
            full = min(count, rest // each)
            if full:
                slots.append((length, rank, full * each, first, each, capacity - free))
                put(free - each * length, first, full)
            rank, rest, first, count = rank + full * each, rest - full * each, first + full, count - full
            if count and rest:
                slots.append((length, rank, rest, first, rest, capacity - free))
                put(free - rest * length, first, 1)
                rank, rest, first, count = rank + rest, 0, first + 1, count - 1
            put(free, first, count)
    return np.array(slots, dtype=np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Pieces with sequence_id and offset: as few sequences of at most capacity as best-fit decreasing needs.

    Pieces (with a length from 1 to capacity, and any other columns) are dealt by ranges of (length, doc_id, piece), so
    their rank within a length is the count in earlier partitions plus the place in their own; a length that holds any
    share of the rows is spread over many partitions. The driver sees one row per (partition, length) present there,
    at most partitions + capacity rows, and the plan, whose size does not depend on the data.
    """
    spark = pieces.sparkSession
    order = [c for c in ("length", "doc_id", "piece") if c in pieces.columns]
    dealt = cut(pieces.repartitionByRange(*order).sortWithinPartitions(*order)
                .withColumn("__part", F.spark_partition_id()).withColumn("__pos", F.monotonically_increasing_id()))
    runs = (dealt.groupBy("__part", "length").agg(F.min("__pos").alias("low"), F.count("*").alias("n"))
            .orderBy("length", "__part").toPandas())
    histogram = runs.groupby("length")["n"].sum()
    slots = plan_best_fit({int(k): int(v) for k, v in histogram.items()}, capacity)
    wide = capacity + 1
    run_key = (runs["__part"].to_numpy(np.int64) * wide + runs["length"].to_numpy(np.int64))
    base = (runs.groupby("length")["n"].cumsum() - runs["n"]).to_numpy(np.int64)
    order_runs = np.argsort(run_key)
    tables = spark.sparkContext.broadcast((run_key[order_runs], (base - runs["low"].to_numpy(np.int64))[order_runs], slots))
    names = list(pieces.columns)
    from pyspark.sql.types import LongType, StructType
    out = StructType([*pieces.schema.fields]).add("sequence_id", LongType()).add("offset", LongType())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, shift, plan = tables.value
        slot_key = plan[:, 0] * (1 << 44) + plan[:, 1]
        by = np.argsort(slot_key)
        slot_key, plan = slot_key[by], plan[by]
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            part = batch.column(len(names)).to_numpy(zero_copy_only=False).astype(np.int64)
            pos = batch.column(len(names) + 1).to_numpy(zero_copy_only=False)
            rank = pos + shift[np.searchsorted(keys, part * wide + length)]
            slot = plan[np.searchsorted(slot_key, length * (1 << 44) + rank, side="right") - 1]
            nth = rank - slot[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(names)], pa.array(slot[:, 3] + nth // slot[:, 4]),
                 pa.array(slot[:, 5] + nth % slot[:, 4] * length)], names=[*names, "sequence_id", "offset"])

    return dealt.mapInArrow(place, out)


def pack_documents(docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048) -> DataFrame:
    """Tokenise docs and pack their pieces; one row per piece with its sequence and its place there.

    Other columns of docs are not read, so their names cannot clash. An empty table gives no rows.
    """
    return pack(cut(token_pieces(docs, tokenizer_path, max_tokens)), max_tokens)
