"""Packing along a space-filling curve.

Each document becomes a hashed token vector, projected to :data:`DIMS`
dimensions and quantised; its Hilbert key orders the documents so that alike
ones are neighbours.  Documents are range-sorted by that key and laid end to
end; the stream is cut every ``max_tokens`` tokens.  A piece never depends on
other rows than through its document's offset in the stream, so no task ever
holds a sequence that others fill, and only the last sequence is padded.

Defined results: a null text is empty and still has its end token; rows with
equal key are ordered by id (null first), then token hash, so that equal
documents cannot pile up in one range; repeated rows are packed each; an empty
table gives no piece; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialframe.llm.common import give_back_memory, map_batches, materialize, partitions_for, pick, slices

MAX_TOKENS = 2048
END_ID = 1
DIMS, BITS, BUCKETS = 4, 12, 256
CACHE_CHUNKS = 400_000
#: Missing chunks that the tokenizer is given in one text.
LINES_AT_ONCE = 4096
_LOADED: dict[str, "ChunkEncoder"] = {}


class ChunkEncoder:
    """Token ids of whole texts, as packed little-endian ids of ``dtype``.

    A byte-level BPE with the usual pre-tokenizer never merges across a single
    space or line feed between two other characters, nor between a letter or
    digit and punctuation other than an apostrophe.  So a text is encoded chunk by
    chunk, and each distinct word once; texts with other runs of white space are
    encoded whole.  The cache holds two generations of some
    :data:`CACHE_CHUNKS` chunks.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.dtype = np.dtype("<u2" if self._tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        (self._feed,) = self._tokenizer.encode("\n", add_special_tokens=False).ids
        self._feed_ids = np.array([self._feed], self.dtype).tobytes()

    @classmethod
    def load(cls, path: str) -> "ChunkEncoder":
        """One encoder per worker process and file."""
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def _whole_ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes()
                for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _line_ids(self, lines: list[str]) -> list[bytes]:
        """Ids of texts without white space but a first space, encoded as the lines of one text.

        The tokenizer keeps some hundred bytes for each token of a text, so that text is short.
        """
        out: list[bytes] = []
        for at in range(0, len(lines), LINES_AT_ONCE):
            (whole,) = self._tokenizer.encode_batch_fast(["\n".join(lines[at:at + LINES_AT_ONCE])],
                                                         add_special_tokens=False)
            ids = np.array(whole.ids, self.dtype)
            raw, size = ids.tobytes(), self.dtype.itemsize
            cuts = (np.flatnonzero(ids == self._feed) * size).tolist()
            out += [raw[s:e] for s, e in zip([0, *(c + size for c in cuts)], [*cuts, len(raw)])]
        return out

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """The cache with all of ``chunks`` in it, none of which it holds yet."""
        young, old = self._young, self._old
        parts: list[tuple[str, str, str]] = []
        missing: dict[str, None] = {}
        for c in chunks:
            known = old.get(c)
            if known is not None:
                young[c] = known
                continue
            if c[-1] in _TAIL:
                word = c.rstrip(_TAIL)
                if word and word[-1].isalnum():
                    tail = "\0" + c[len(word):]
                    parts.append((c, word, tail))
                    for w in (word, tail):
                        if w not in young:
                            known = old.get(w)
                            if known is None:
                                missing[w] = None
                            else:
                                young[w] = known
                    continue
            missing[c] = None
        # A chunk is a word after a space, a line feed and a word, or (marked) what follows neither.
        plain = [c[1:] if c[0] in "\0\n" else " " + c for c in missing]
        for c, ids in zip(missing, self._line_ids(plain)):
            young[c] = self._feed_ids + ids if c[0] == "\n" else ids
        for c, word, tail in parts:
            young[c] = young[word] + young[tail]
        return young

    def _ids_of(self, names: list[str]) -> list[bytes]:
        """Ids of distinct chunks.  Of the cache's two generations, the older one is dropped when the newer fills."""
        if len(self._young) > CACHE_CHUNKS:
            self._young, self._old = {}, self._young
        known = list(map(self._young.get, names))
        absent = [i for i, ids in enumerate(known) if ids is None]
        young = self._learn([names[i] for i in absent])
        for i in absent:
            known[i] = young[names[i]]
        return known

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of every text; the chunks of all texts are looked up once each."""
        out = [b""] * len(texts)
        column = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(column, _ODD_SPACE).to_numpy(zero_copy_only=False)
        whole, plain = np.flatnonzero(odd).tolist(), np.flatnonzero(~odd).tolist()
        for i, ids in zip(whole, self._whole_ids([texts[i] for i in whole])):
            out[i] = ids
        if not plain:
            return out
        chunks = pc.split_pattern(pa.array(["\0" + texts[i].replace("\n", " \n") for i in plain], pa.large_string()), " ")
        coded = pc.dictionary_encode(chunks.values)
        names, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        known = self._ids_of(names)
        ids = np.frombuffer(b"".join(known), self.dtype)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
        # The ids of every chunk in a row: its place in `ids` and those after it.
        n = sizes[codes]
        ends = np.cumsum(n)
        stream = ids[np.repeat((np.cumsum(sizes) - sizes)[codes] - (ends - n), n) + np.arange(ends[-1])]
        bounds = np.append(0, ends)[chunks.offsets.to_numpy()]
        for i, a, b in zip(plain, bounds.tolist(), bounds[1:].tolist()):
            out[i] = stream[a:b].tobytes()
        return out


#: Texts that are encoded whole: empty, with a zero byte, or with white space other than
#: single spaces and line feeds between two other characters.
_ODD_SPACE = (r"[\x00\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}"
              r"\x{3000}]|[ \n][ \n]|^[ \n]|[ \n]$|^$")
#: Punctuation that is split from a word's end.
_TAIL = ".,;:!?*$%&#|)]}\"-_"


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of integer points (rows of ``cells``), Skilling's transform."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(flip)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _normal_share(z: np.ndarray) -> np.ndarray:
    """Normal distribution function (logistic approximation), to spread the cells evenly."""
    return 1 / (1 + np.exp(-np.clip(1.702 * z, -40, 40)))


def document_cells(ids: list[np.ndarray]) -> np.ndarray:
    """Hashed token counts of each document, projected to :data:`DIMS` cells per dimension."""
    rows = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    flat = np.concatenate(ids).astype(np.uint32) if ids else np.zeros(0, np.uint32)
    bucket = (flat * np.uint32(0x9E3779B1)) >> np.uint32(24)
    vectors = np.bincount(rows * BUCKETS + bucket, minlength=len(ids) * BUCKETS).reshape(-1, BUCKETS)
    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1)
    plane = np.random.default_rng(5).normal(size=(BUCKETS, DIMS))
    # Rounded so that the order of additions cannot move a cell.
    share = np.round(_normal_share(vectors @ plane), 9)
    return np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, key, n_tokens and packed ids (end id included) of every (doc_id, text) row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        encoder = ChunkEncoder.load(tokenizer_path)
        end = np.array([end_id], encoder.dtype).tobytes()
        for b in slices(batches, "text", 2_000_000):
            packed = [x + end for x in encoder.encode([t or "" for t in b.column("text").to_pylist()])]
            ids = [np.frombuffer(x, encoder.dtype) for x in packed]
            stored = packed if encoder.dtype.itemsize == 2 else [b"\0" + x for x in packed]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(hilbert_keys(document_cells(ids))),
                 pa.array([len(x) for x in ids], pa.int64()), pa.array(stored, pa.binary())],
                names=["doc_id", "key", "n_tokens", "ids"])
    return map_batches(docs, run, "doc_id long, key long, n_tokens long, ids binary")


def unpack(ids: bytes) -> np.ndarray:
    """Ids of a stored row: two bytes each, or (odd length) a zero byte and four bytes each."""
    return np.frombuffer(ids, "<u4", offset=1) if len(ids) % 2 else np.frombuffer(ids, "<u2").astype("<u4")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and the tokens before each row in it."""
    part, before = TaskContext.get().partitionId(), 0
    for b in batches:
        ends = before + np.cumsum(b.column("n_tokens").to_numpy(zero_copy_only=False))
        starts = ends - b.column("n_tokens").to_numpy(zero_copy_only=False)
        before = int(ends[-1]) if len(ends) else before
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(np.full(b.num_rows, part)), pa.array(starts.astype(np.int64))],
            names=[*b.schema.names, "part", "part_start"])


def order_along_curve(tokens: DataFrame) -> DataFrame:
    """The tokenized rows range-sorted by key, each with its offset in the global stream (``stream_start``)."""
    spark = tokens.sparkSession
    tokens = materialize(tokens, "pack-tokens")  # range bounds are sampled from it: tokenize once
    ranged = (tokens.withColumn("_tie", F.xxhash64("ids"))
              .repartitionByRange(partitions_for(spark), "key", "doc_id", "_tie")
              .sortWithinPartitions("key", "doc_id", "_tie").drop("_tie"))
    laid = materialize(map_batches(
        ranged, _running, "doc_id long, key long, n_tokens long, ids binary, part long, part_start long"), "pack-order")
    # One row per partition: bounded by the partition count.
    totals = laid.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    starts, before = [], 0
    for r in totals:
        starts.append((r.part, before))
        before += r.n
    offsets = spark.createDataFrame(starts, "part long, part_offset long")
    return (laid.join(F.broadcast(offsets), "part")
            .select("doc_id", "n_tokens", "ids", (F.col("part_offset") + F.col("part_start")).alias("stream_start")))


def cut(laid: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (packed, 32 bits each)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "ids"):
            cols: list[list] = [[] for _ in range(8)]
            for doc, n, packed, at in zip(*(b.column(c).to_pylist() for c in
                                            ("doc_id", "n_tokens", "ids", "stream_start"))):
                raw, start = unpack(packed).tobytes(), 0
                while start < n:
                    length = min(n - start, max_tokens - (at + start) % max_tokens)
                    ids = raw[4 * start:4 * (start + length)]
                    for c, v in zip(cols, (doc, start, length, zlib.crc32(ids), n, (at + start) // max_tokens,
                                           (at + start) % max_tokens, ids)):
                        c.append(v)
                    start += length
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(cols[7], pa.binary())], names=_PIECE)
    return map_batches(laid, run, ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in _PIECE))


_PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text",
         max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """All documents as pieces of sequences of at most ``max_tokens`` tokens."""
    rows = pick(docs, doc_id=doc_id, text=text)
    return cut(order_along_curve(tokenize(rows, tokenizer_path, end_id)), max_tokens)


def sequences(pieces: DataFrame, pad_id: int = 0, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """sequence_id, n_tokens and ids of whole sequences, padded unless the length is a power of two.

    A group is at most ``max_tokens`` pieces.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pad = np.array([pad_id], "<u4").tobytes()
        for b in batches:
            out, sizes = [], []
            for parts in b.column("parts").to_pylist():
                ids = b"".join(p["ids"] for p in sorted(parts, key=lambda p: p["offset"]))
                n = len(ids) // 4
                sizes.append(n)
                out.append(ids if n & (n - 1) == 0 else ids + pad * (max_tokens - n))
            yield pa.RecordBatch.from_arrays([b.column("sequence_id"), pa.array(sizes, pa.int64()),
                                              pa.array(out, pa.binary())], names=["sequence_id", "n_tokens", "ids"])
    grouped = pieces.groupBy("sequence_id").agg(F.collect_list(F.struct("offset", "ids")).alias("parts"))
    return map_batches(grouped, run, "sequence_id long, n_tokens long, ids binary")
