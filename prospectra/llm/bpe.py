"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pieces of a slice of the corpus lie in one token array. An inverted index gives, for each merge rank, the
places where that pair stands; the merges are replayed in rank order over all pieces at once, and each one looks again
only at the neighbours of the places that it touched.
"""

from __future__ import annotations

import base64
import heapq
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Text bytes whose distinct pieces are merged together.
SLICE_BYTES = 3 << 20
#: Token ids that are decoded together.
SLICE_IDS = 1 << 20
NONE = np.iinfo(np.int32).max

_AFTER_SPACE = re.compile(r" (?:\s|$)")


class Vocabulary:
    """Ranks of a byte-level BPE, its pre-token pattern, and tables for encoding and decoding."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.size = max(ranks.values()) + 1
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        codes, merged = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    codes.append(left * self.size + right)
                    merged.append(rank)
        order = np.argsort(codes)
        self.codes, self.merged = np.array(codes, dtype=np.int64)[order], np.array(merged, dtype=np.int32)[order]
        by_id = [b""] * self.size
        for token, rank in ranks.items():
            by_id[rank] = token
        self.lengths = np.array([len(t) for t in by_id], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(by_id), dtype=np.uint8)

    @classmethod
    def read(cls, lines: bytes, pattern: str) -> Vocabulary:
        pairs = (line.split() for line in lines.splitlines() if line.strip())
        return cls({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair merges into, NONE for pairs that do not merge."""
        code = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        return np.where(self.codes[at] == code, self.merged[at], NONE)


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of the runs [start, start + length), one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def replay_merges(pieces: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pieces, one after another, and the number of each piece's ids."""
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    token = vocab.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    n = len(token)
    if not n:
        return token, np.zeros(len(pieces), dtype=np.int64)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    ends = np.cumsum(sizes)
    ends = ends[sizes > 0]
    after[ends - 1] = -1
    before[np.concatenate([[0], ends[:-1]])] = -1
    pair = np.full(n, NONE, dtype=np.int32)  # rank of the pair that starts at a place
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def look(places: np.ndarray) -> None:
        """Find the ranks of the pairs that start at these places and enter them in the index."""
        places = places[after[places] >= 0]
        found = vocab.rank(token[places], token[after[places]])
        pair[places] = found
        keep = found != NONE
        places, found = places[keep], found[keep]
        if not len(places):
            return
        order = np.argsort(found, kind="stable")
        places, found = places[order], found[order]
        cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
        first = 0
        for stop in [*cuts.tolist(), len(found)]:
            rank = int(found[first])
            if rank in index:
                index[rank].append(places[first:stop])
            else:
                index[rank] = [places[first:stop]]
                heapq.heappush(heap, rank)
            first = stop

    look(np.arange(n))
    while heap:
        rank = heapq.heappop(heap)
        lists = index.pop(rank)
        places = lists[0] if len(lists) == 1 else np.concatenate(lists)
        places = np.unique(places[pair[places] == rank])
        if len(places) > 1:  # in a run of overlapping pairs every second one merges
            linked = after[places[:-1]] == places[1:]
            if linked.any():
                place = np.arange(len(places))
                head = np.maximum.accumulate(np.where(np.concatenate([[True], ~linked]), place, 0))
                places = places[(place - head) % 2 == 0]
        if not len(places):
            continue
        gone = after[places]
        follow = after[gone]
        token[places], token[gone] = rank, -1
        pair[places], pair[gone] = NONE, NONE
        after[places] = follow
        inner = follow >= 0
        before[follow[inner]] = places[inner]
        left = before[places]
        left = left[left >= 0]
        pair[left] = NONE
        look(np.unique(np.concatenate([places, left])))
    piece = np.repeat(np.arange(len(pieces)), sizes)
    live = token >= 0
    return token[live], np.bincount(piece[live], minlength=len(pieces))


class _Index(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _chunks(text: str) -> list[str]:
    """Cut before each space that a character other than white space follows: no pre-token crosses there.

    All but the first chunk lack that leading space.
    """
    parts = text.split(" ")
    if not _AFTER_SPACE.search(text):
        return parts
    out = [parts[0]]
    for p in parts[1:]:
        if p and not p[0].isspace():
            out.append(p)
        else:
            out[-1] += " " + p
    return out


def encode_texts(texts: list[str | None], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and the number of each text's ids."""
    heads, tails = _Index(), _Index()
    head_of, tail_of, n_tails = [], [], []
    for text in texts:
        parts = _chunks(text or "")
        head_of.append(heads[parts[0]])
        tail_of.append(np.fromiter(map(tails.__getitem__, parts[1:]), dtype=np.int32, count=len(parts) - 1))
        n_tails.append(len(parts) - 1)
    pieces = _Index()
    of_chunk, per_chunk = [], []
    split = vocab.pattern.findall
    for chunk in [*heads, *(" " + t for t in tails)]:
        found = split(chunk)
        of_chunk += map(pieces.__getitem__, found)
        per_chunk.append(len(found))
    ids, n_ids = replay_merges([p.encode() for p in pieces], vocab)
    # pieces -> chunks -> texts, each by lengths and offsets
    of_chunk, per_chunk = np.array(of_chunk, dtype=np.int64), np.array(per_chunk, dtype=np.int64)
    piece_start = np.cumsum(n_ids) - n_ids
    chunk_ids = ids[_gather(piece_start[of_chunk], n_ids[of_chunk])]
    sums = np.concatenate([[0], np.cumsum(n_ids[of_chunk])])
    stops = np.cumsum(per_chunk)
    chunk_n, chunk_start = sums[stops] - sums[stops - per_chunk], sums[stops - per_chunk]
    n_tails = np.array(n_tails, dtype=np.int64)
    chunk_of = np.empty(len(texts) + int(n_tails.sum()), dtype=np.int64)
    first = np.cumsum(n_tails + 1) - n_tails - 1
    chunk_of[first] = head_of
    rest = np.ones(len(chunk_of), dtype=bool)
    rest[first] = False
    chunk_of[rest] = np.concatenate([*tail_of, np.zeros(0, dtype=np.int32)]) + len(heads)
    lengths = chunk_n[chunk_of]
    per_text = np.add.reduceat(lengths, first) if len(first) else np.zeros(0, dtype=np.int64)
    return chunk_ids[_gather(chunk_start[chunk_of], lengths)], per_text


def _offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)


def load_vocabulary(spark: SparkSession, path: str | None = None):
    """The vocabulary file's lines, read once by the driver (a fixed-size file of a public tokenizer) and broadcast."""
    import public_tokenizers

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return spark.sparkContext.broadcast((f.read(), public_tokenizers.PATTERN))


_CACHE: dict[int, Vocabulary] = {}


def _vocabulary(sent) -> Vocabulary:
    key = hash(sent.value)
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = Vocabulary.read(*sent.value)
    return _CACHE[key]


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """Add ``ids``, the token ids of each whole text, without special tokens.

    A null or empty text has no ids; repeated rows are encoded alike; an empty table stays empty; all other columns pass
    through, but a column named ``ids`` is replaced.
    """
    sent = load_vocabulary(docs.sparkSession, path)
    keep = [c for c in docs.columns if c != "ids"]
    at = keep.index(text_col)

    def run(batches):
        vocab = _vocabulary(sent)
        for b in slices(batches, SLICE_BYTES):
            ids, lengths = encode_texts(b.column(at).to_pylist(), vocab)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(_offsets(lengths), pa.array(ids, pa.int32()))], names=[*b.schema.names, "ids"])

    rows = docs.select(*keep)
    return rows.mapInArrow(run, _schema(rows, "ids array<int>"))


def _decoded(lists: pa.ListArray, vocab: Vocabulary) -> pa.Array:
    """The bytes that each list of ids stands for; null lists give none."""
    ids, n = lists.flatten().to_numpy(), pc.fill_null(lists.value_lengths(), 0).to_numpy()
    lengths = vocab.lengths[ids]
    data = vocab.bytes[_gather(vocab.starts[ids], lengths)]
    sums = np.concatenate([[0], np.cumsum(lengths)])
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(sums[_offsets(n)].astype(np.int32)), pa.py_buffer(data)])


def _schema(rows: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *more])


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Add ``decoded``, the bytes that the ``ids`` stand for; null ids give no bytes."""
    sent = load_vocabulary(encoded.sparkSession, path)
    keep = [c for c in encoded.columns if c != "decoded"]
    at = keep.index("ids")

    def run(batches):
        vocab = _vocabulary(sent)
        for whole in batches:
            ends = np.cumsum(pc.fill_null(whole.column(at).value_lengths(), 0).to_numpy())
            cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, SLICE_IDS)[1:]))
            for first, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), whole.num_rows], strict=True):
                b = whole.slice(first, stop - first)
                yield pa.RecordBatch.from_arrays([*b.columns, _decoded(b.column(at), vocab)], names=[*b.schema.names, "decoded"])

    rows = encoded.select(*keep)
    return rows.mapInArrow(run, _schema(rows, "decoded binary"))


def round_trip(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` and ``decoded`` in place of the text: encoding, then decoding of the ids, in one pass."""
    sent = load_vocabulary(docs.sparkSession, path)
    keep = [c for c in docs.columns if c not in ("ids", "decoded", text_col)]

    def run(batches):
        vocab = _vocabulary(sent)
        for b in slices(batches, SLICE_BYTES):
            ids, lengths = encode_texts(b.column(len(keep)).to_pylist(), vocab)
            lists = pa.ListArray.from_arrays(_offsets(lengths), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists, _decoded(lists, vocab)], names=[*keep, "ids", "decoded"])

    rows = docs.select(*keep)
    return docs.select(*keep, text_col).mapInArrow(run, _schema(rows, "ids array<int>", "decoded binary"))


def digests(encoded: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Digest columns of an encoded and decoded table, with the columns of ``keep``."""
    joined = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *keep,
    )


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(round_trip(docs))
