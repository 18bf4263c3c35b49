"""Records whose header is longer than any buffer."""

from __future__ import annotations

import gzip
import io
import random

from crosspanel.llm import warc


def test_a_long_url_is_read_back():
    rng = random.Random(3)
    url = "http://x/" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(300_000))
    data = b"".join(gzip.compress(warc.record(k, u, b"text", None, False), 4, mtime=0) + warc.EMPTY_MEMBER for k, u in enumerate(["http://a", url, "http://b"]))
    found = list(warc.read_range(io.BytesIO(data), len(data), 0, len(data)))
    assert [f["warc-target-uri"] for f, _, _ in found] == ["http://a", url, "http://b"]
