"""Payloads stored as content-defined chunks, each kept once, and read back from their chunk lists."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut

#: Least and most bytes of a chunk; a cut comes where the top bits of the rolling hash are 0.
LEAST, MOST, BITS = 2048, 16384, 12
#: Documents and bytes that the compression dictionary is trained on at most, and its size.
SAMPLE, SAMPLE_BYTES, DICTIONARY = 1500, 4096, 1 << 16
LEVEL = 9
UNIT = 64
_MAGIC = b"KFCL\x01"

_rng_state = np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x1234567)
GEAR = ((_rng_state ^ (_rng_state >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)


def payload(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % UNIT if data else UNIT)


def gear(data: bytes) -> np.ndarray:
    """The rolling gear hash h = 2 h + G[byte] (mod 2**32) at each byte, which depends on the last 32 bytes."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for w in (1, 2, 4, 8, 16):
        more = h.copy()
        more[w:] += h[:-w] << np.uint32(w)
        h = more
    return h


def chunks(data: bytes) -> list[bytes]:
    """Cut where the hash says so, no chunk shorter than LEAST (the last may be) or longer than MOST."""
    out, a, n = [], 0, len(data)
    if n > LEAST:
        marks = np.flatnonzero(gear(data) >> np.uint32(32 - BITS) == 0) + 1
        while n - a > LEAST:
            i = np.searchsorted(marks, a + LEAST)
            b = min(n, a + MOST, int(marks[i]) if i < len(marks) else n)
            out.append(data[a:b])
            a = b
    if a < n:
        out.append(data[a:])
    return out


def chunk_list(size: int, unpadded: int, digests: list[bytes]) -> bytes:
    """The stored form of one payload: a header with its sizes, then its chunks' digests in order."""
    return _MAGIC + struct.pack("<QQI", size, unpadded, len(digests)) + b"".join(digests)


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _listed(with_data: bool, dictionary: bytes):
    """Rows (id, n_bytes, media, list) for the chunk lists, or (digest, data) for the chunks, those first in the batch."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        seen: set[bytes] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                lists, sizes, stored = [], [], {}
                for text in batch.column(1).to_pylist():
                    data = payload(text)
                    parts = chunks(data)
                    digests = [_digest(x) for x in parts]
                    if with_data:
                        stored.update((d, x) for d, x in zip(digests, parts, strict=True) if d not in seen)
                    else:
                        sizes.append(len((text or "").encode("utf-8", "surrogatepass")))
                        lists.append(chunk_list(len(data), sizes[-1], digests))
                if with_data:
                    # Only to send less: what comes again later is deduplicated by the join's side.
                    seen = seen | stored.keys() if len(seen) < 200_000 else set(stored)
                    yield pa.RecordBatch.from_arrays([pa.array(list(stored), pa.binary()), pa.array([pack.compress(x) for x in stored.values()], pa.binary())], names=["digest", "data"])
                else:
                    media = [hashlib.sha256(x).digest() for x in lists]
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(lists, pa.binary())], names=["id", "n_bytes", "media", "list"])

    return apply


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media, pos, digest, count = [], [], [], []
        for m, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            head = len(_MAGIC) + 20
            n = struct.unpack_from("<QQI", listed, len(_MAGIC))[2]
            media += [m] * n
            pos += range(n)
            count += [n] * n
            digest += [listed[head + 32 * i : head + 32 * i + 32] for i in range(n)]
        yield pa.RecordBatch.from_arrays([pa.array(media, pa.binary()), pa.array(pos, pa.int32()), pa.array(count, pa.int32()), pa.array(digest, pa.binary())], names=["media", "pos", "n", "digest"])


_DONE = ("payload_bytes", "payload_sha256", "tail_crc32", "feature", "chunk_bytes")
_TYPES = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())


class _Reader:
    """Rebuilds payloads from their chunks in order, checks each digest, and describes the samples."""

    def __init__(self, dictionary: bytes) -> None:
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def read(self, media: bytes, n: int, parts: list[tuple[int, bytes, bytes]]) -> tuple[int, str, int, str, int]:
        """From (pos, digest, stored bytes) of all chunks."""
        pieces = []
        for _, digest, stored in sorted(parts):
            data = self.unpack.decompress(stored, max_output_size=MOST)
            if _digest(data) != digest:
                raise ValueError(f"a chunk of {media.hex()} does not match its digest")
            pieces.append(data)
        if len(pieces) != n:
            raise ValueError(f"{media.hex()} has {len(pieces)} of {n} chunks")
        data = b"".join(pieces)
        x = np.frombuffer(data, np.uint8)
        counts = np.bincount(x, minlength=256)
        p = counts[counts > 0] / len(x)
        feature = f"chunks={n};mean={x.mean():.4f};std={x.std():.4f};entropy={max(0.0, -(p * np.log2(p)).sum()):.4f};zeros={counts[0]}"
        return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), feature, sum(len(stored) for _, _, stored in parts)


def _read_alone(dictionary: bytes):
    """Payloads of one chunk are read where the join has put it; the chunks of others go on."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(dictionary)
        for batch in batches:
            data, done = [], []
            for media, n, pos, digest, stored in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data.append(None if n == 1 else stored)
                done.append(reader.read(media, n, [(pos, digest, stored)]) if n == 1 else (None,) * len(_DONE))
            columns = list(zip(*done, strict=True)) or [()] * len(_DONE)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(data, pa.binary()), *(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True))], names=["media", "n", "pos", "digest", "data", *_DONE])

    return apply


def _read(dictionary: bytes):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(dictionary)
        for batch in batches:
            rows = []
            for media, n, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one = parts[0]
                rows.append((media, *((one[k] for k in _DONE) if n == 1 else reader.read(media, n, [(p["pos"], p["digest"], p["data"]) for p in parts]))))
            columns = list(zip(*rows, strict=True)) or [()] * (1 + len(_DONE))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), *_TYPES), strict=True)], names=["media", *_DONE])

    return apply


def dictionary(docs: DataFrame, id_col: str, text_col: str) -> bytes:
    """A compression dictionary from the heads of at most about SAMPLE documents, chosen by hash; empty if there are too few."""
    n = docs.count()
    key = F.pmod(F.xxhash64(id_col, F.lit("dictionary")), F.lit(1 << 20))
    rows = docs.where(key < max(1, int(min(1.0, SAMPLE / max(1, n)) * (1 << 20)))).select(F.substring(F.col(text_col).cast("binary"), 1, SAMPLE_BYTES).alias("b"))
    heads = sorted({bytes(r["b"]) for r in rows.limit(2 * SAMPLE).collect() if r["b"]})
    try:
        return zstandard.train_dictionary(DICTIONARY, heads).as_bytes() if len(heads) >= 100 else b""
    except zstandard.ZstdError:
        return b""


class Store(NamedTuple):
    """Tables from which every payload can be rebuilt, in the folder of store.py until release()."""

    #: digest, data (compressed): each chunk once.
    chunks: DataFrame
    #: id, n_bytes, media, list: a row for each input row.
    lists: DataFrame
    #: data: one row, the dictionary that the chunks are compressed with; empty if there is none.
    dictionary: DataFrame


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Store:
    """Write the payloads' chunks, their lists and the dictionary."""
    trained = dictionary(docs, id_col, text_col)
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    lists = cut(source.mapInArrow(_listed(False, trained), f"id {source.schema['id'].dataType.simpleString()}, n_bytes long, media binary, list binary"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = source.mapInArrow(_listed(True, trained), "digest binary, data binary").repartition(parts, "digest")
    chunks = cut(found.groupBy("digest").agg(F.first("data").alias("data")), (parts, "digest"))
    return Store(chunks, lists, cut(spark.createDataFrame([(bytearray(trained),)], "data binary")))


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, chunk_bytes.

    A payload is the text's UTF-8 bytes and bytes 0 up to a positive multiple of 64. It is stored as the ordered list of
    its chunks' digests; each chunk is stored once, however many payloads hold it (store() returns the tables). Equal payloads
    have one list, which is read back once from the tables written: its chunks come by a join on their digests.
    media_bytes and media_sha256 are of that list; chunk_bytes is what its chunks take in the store, which other payloads may share.
    Null text is empty (64 bytes 0); other columns, of whatever name, are ignored; null ids and repeated rows have rows of their own; an empty table gives an empty one.
    The dictionary changes how chunks are compressed, which of the values returned only chunk_bytes shows.
    """
    kept, lists, trained = store(docs, id_col, text_col)
    trained = bytes(trained.first()["data"])
    entries = lists.groupBy("media").agg(F.first("list").alias("list")).mapInArrow(_entries, "media binary, pos int, n int, digest binary")
    found = entries.join(kept, "digest").select("media", "n", "pos", "digest", "data")
    schema = "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, chunk_bytes long"
    found = found.mapInArrow(_read_alone(trained), f"media binary, n int, pos int, digest binary, data binary, {schema}")
    parts = F.collect_list(F.struct("pos", "digest", "data", *_DONE)).alias("parts")
    whole = found.groupBy("media", "n").agg(parts).mapInArrow(_read(trained), f"media binary, {schema}")
    forms = lists.select("id", "n_bytes", "media", F.octet_length("list").cast("long").alias("media_bytes"))
    out = forms.join(cut(whole), "media")
    return out.select(F.col("id").alias(id_col), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.lower(F.hex("media")).alias("media_sha256"), "feature", "chunk_bytes")
