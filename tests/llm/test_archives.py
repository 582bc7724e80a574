"""Archives as others write them: one gzip member a record, padding, a member for all."""

import gzip
import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pytest

from sitewise.llm import suffix, warc
from sitewise.llm.anchors import RunIndex


def public_archive(pages, padding=b""):
    """Each record a gzip member of its own."""
    out = b""
    for i, html in pages:
        digest = hashlib.sha256(html).hexdigest()
        for made in warc.page_records(i, "http://a.example/x", html, digest, None, False, 5000):
            out += gzip.compress(made + warc.END)
    return out + padding


def test_members_are_read_to_the_end(spark, tmp_path):
    rng = random.Random(4)
    pages = [(i, bytes(rng.randrange(256) for _ in range(rng.choice([0, 10, 400, 30_000])))) for i in range(40)]
    (tmp_path / "a.warc.gz").write_bytes(public_archive(pages[:20], b"\0" * 7))
    (tmp_path / "b.warc.gz").write_bytes(public_archive(pages[20:30]))
    plain = gzip.decompress(public_archive(pages[30:]))
    (tmp_path / "c.warc").write_bytes(plain)
    (tmp_path / "d.warc.gz").write_bytes(b"")
    got = warc.read_archives(spark, str(tmp_path))
    assert got.where("not intact").count() == 0
    want = sorted((i, len(html), hashlib.sha256(html).hexdigest()) for i, html in pages)
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got.collect()) == want


@pytest.mark.parametrize("step", [1, 7, 1 << 16])
def test_inflated(step):
    parts = [b"", b"one" * 50, b"two", bytes(300)]
    data = b"".join(gzip.compress(p) for p in parts)
    assert warc.inflated(data, step) == b"".join(parts)
    assert warc.inflated(gzip.compress(b"".join(parts)) + b"\0\0", step) == b"".join(parts)
    with pytest.raises((ValueError, zlib.error)):
        warc.inflated(data[:-3], step)


def test_an_index_of_full_size_needs_little_memory():
    """Six workers build one at the same time next to the heap of an executor of 3 GB."""
    rng = np.random.default_rng(0)
    for size in (suffix.INDEX_BYTES, suffix.HOT_RUNS * 150):
        cut = [rng.integers(97, 110, 150, dtype=np.uint8).tobytes() for _ in range(size // 300)] * 2
        tracemalloc.start()
        index = RunIndex(cut)
        again = index.repeats(np.arange(len(index.text), dtype=np.int64))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert again.sum() == len(cut) // 2 * 51 and peak < 150e6
