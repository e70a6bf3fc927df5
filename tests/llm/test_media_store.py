"""Payloads are rebuilt from the tables that the media store has written, and from nothing else."""

import hashlib
import struct

import pytest
import zstandard

from kinfold.llm import media
from kinfold.llm.store import shared_folder


def test_payloads_come_back_from_the_files(spark):
    texts = [" ".join(str(i * k * k) for k in range(n)) for i, n in enumerate((0, 3, 4000, 4000, 9000))]
    rows = [*enumerate(texts), (7, texts[4]), (8, None), (None, texts[2] + texts[4])]
    out = media.store(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    lists, chunks, trained = (spark.read.parquet(*df.inputFiles()).collect() for df in (out.lists, out.chunks, out.dictionary))
    assert all(f.startswith("file:") and "/kinfold/" in f for df in out for f in df.inputFiles()) and shared_folder(spark)
    assert len(chunks) == len({bytes(r["digest"]) for r in chunks}) < sum(len(media.chunks(media.payload(t))) for _, t in rows)
    data = bytes(trained[0]["data"])
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None)
    plain = {bytes(r["digest"]): unpack.decompress(bytes(r["data"]), max_output_size=media.MOST) for r in chunks}
    assert all(hashlib.sha256(x).digest() == d for d, x in plain.items())
    expected = {i: media.payload(t) for i, t in rows}
    assert len(lists) == len(rows)
    for r in lists:
        listed = bytes(r["list"])
        n = struct.unpack_from("<QQI", listed, 5)[2]
        assert b"".join(plain[listed[25 + 32 * i : 57 + 32 * i]] for i in range(n)) == expected[r["id"]]


def test_damaged_and_missing_chunks_are_told():
    pack, parts = zstandard.ZstdCompressor(), [b"a" * 5000, b"b" * 64]
    digests = [hashlib.sha256(x).digest() for x in parts]
    stored = [pack.compress(x) for x in parts]
    reader = media._Reader(b"")
    assert reader.read(b"m", 2, [(1, digests[1], stored[1]), (0, digests[0], stored[0])])[:2] == (5064, hashlib.sha256(b"".join(parts)).hexdigest())
    with pytest.raises(ValueError, match="does not match"):
        reader.read(b"m", 2, [(0, digests[0], stored[0]), (1, digests[1], pack.compress(b"c" * 64))])
    with pytest.raises(ValueError, match="1 of 2 chunks"):
        reader.read(b"m", 2, [(0, digests[0], stored[0])])
    with pytest.raises(zstandard.ZstdError):
        reader.read(b"m", 1, [(0, digests[0], stored[0][:-7])])
