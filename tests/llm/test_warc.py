import hashlib
import io
import random

import pytest

from chronoloom.llm import warc

ROWS = [(i, f"https://h{i % 3}.example/{i}", ("page %d " % i) * (i * 3 % 400)) for i in range(300)]
ROWS += [(1000 + i, None, "the same payload " * 80) for i in range(400)]
ROWS += [(5000, "u", "short copy"), (5001, "u", "short copy"), (None, "u", "the same payload " * 80), (6000, "u\r\nX: y", None), (6001, "", ""), (7000, "é", "é" * 700), (7001, "é", "é" * 700), (7001, "é", "é" * 700)]


def want(rows):
    out = []
    for p, _, html in rows:
        body = (html or "").encode()
        same = [q for q, _, h in rows if (h or "").encode() == body and q is not None]
        winner = max(same) if same and len(body) >= 1000 else p
        out.append((p, len(body), hashlib.sha1(body).hexdigest(), "response" if p == winner else "revisit", None if p == winner else winner))
    return out


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*r, 1, "clash") for r in ROWS], "page_id long, url string, html string, digest int, winner string")
    got = warc.round_trip(pages).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want(ROWS), key=str)
    texts = {p: (h or "").encode() for p, _, h in ROWS}
    assert all(r.payload == texts[r.page_id] for r in got if r.record_type == "response")


@pytest.mark.parametrize("split", [700, 5000, 1 << 20])
def test_every_split_size_finds_every_record_once(spark, tmp_path, split):
    path = str(tmp_path / "a")
    warc.write_warc(spark.createDataFrame(ROWS, "page_id long, url string, html string"), path)
    got = warc.read_warc(spark, path, split).collect()
    assert sorted(((r.page_id, r.digest) for r in got), key=str) == sorted(((w[0], w[2]) for w in want(ROWS)), key=str)


def test_magic_inside_payload_and_large_records():
    rng = random.Random(1)
    bodies = [b"\x1f\x8b\x08" * 50, rng.randbytes(1 << 17) + warc.page_record(1, "u", b"inner", None) * 3, b"x" * (1 << 24)]
    data = b"".join(warc.page_record(i, None, b, None) for i, b in enumerate(bodies)) + warc._EMPTY_MEMBER
    step = 40_000
    seen = [f["warc-record-id"] + str(len(b)) for s in range(0, len(data), step) for _, f, b in warc.scan_range(io.BytesIO(data), s, min(s + step, len(data)))]
    assert len(seen) == len(bodies) and len(set(seen)) == len(bodies)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_a_range_is_read_once():
    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            found = super().read(n)
            Counted.taken += len(found)
            return found

    rng = random.Random(2)
    data = b"".join(warc.page_record(i, None, rng.randbytes(700), None) for i in range(3000))
    assert len(list(warc.scan_range(Counted(data), 0, len(data)))) == 3000
    assert Counted.taken < 1.5 * len(data)
