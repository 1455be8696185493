"""Archives: round trips by ranges of any size, revisits, damage, and Python's own gzip as a second reader."""

import gzip
import hashlib
import random

import pytest

from repolens.llm import warc

COLUMNS = "page_id long, url string, html string, size long, id int"


def pages(rng):
    body = lambda n: "".join(rng.choice("<p>abcé日 \n") for _ in range(n))
    rows = [(i, f"http://a.example/{i}?q=%20", body(rng.choice([0, 5, 90, 150, 3000])), 1, 2) for i in range(60)]
    same = body(200)
    rows += [(100 + i, "http://b.example/", same, 1, 2) for i in range(30)]
    rows += [(200, None, None, 1, 2), (201, "x y\r\nWARC-Type: fake", "é" * 50, None, 2), (202, "ü", "é" * 50, 1, 2), (203, "s", "z" * 99, 1, 2),
             (204, "s", "z" * 99, 1, 2), (None, "n", same, 1, 2), (None, None, None, 1, 2), (205, "long", body(300_000), 1, 2)]
    rng.shuffle(rows)
    return rows + [rows[0], rows[0], rows[5]] + [r for r in rows if r[0] in (100, 110, 205)]


def want(rows):
    first = {}
    for p, _, html, *_ in rows:
        data = (html or "").encode()
        if len(data) >= 100:
            first.setdefault(data, []).append((p is None, p or 0))
    out, used = [], set()
    for p, _, html, *_ in rows:
        data = (html or "").encode()
        least = min(first.get(data, [(p is None, p or 0)]))
        again = len(data) >= 100 and ((p is None, p or 0) != least or data in used)
        if len(data) >= 100 and (p is None, p or 0) == least:
            used.add(data)
        out.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", (None if least[0] else least[1]) if again else None))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


@pytest.mark.parametrize("file_bytes, split", [(warc.FILE_BYTES, warc.SPLIT_BYTES), (3000, 700)])
def test_round_trip(spark, file_bytes, split, monkeypatch, tmp_path):
    rows = pages(random.Random(5))
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    manifest = warc.write(warc.page_records(df), str(tmp_path), file_bytes)
    back = warc.read(manifest, split).where("record_type <> 'warcinfo'").cache()
    assert back.where("error is not null").count() == 0
    sent = sorted(((p, u, h or "") for p, u, h, *_ in rows if p is not None), key=str)
    got = {r.payload_digest: bytes(r.payload) for r in back.where("payload is not null").collect()}
    assert sorted(((int(r.id), r.url, got[r.payload_digest].decode()) for r in back.collect() if r.id is not None), key=str) == sent
    kept = {r.record_id: r.payload_digest for r in back.collect()}
    assert len(kept) == len(rows)  # record ids are unique
    for f in manifest.collect():  # every file is plain gzip, read by another reader
        text = gzip.open(f.path).read()
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and text.count(b"\r\nWARC-Record-ID:") >= f.records + 1
    assert result(warc.archived(df, file_bytes=file_bytes, split_bytes=split)) == want(rows)


def test_hot_payload_goes_by_broadcast(spark, monkeypatch):
    rows = [(i, "u", "h" * 200 if i % 3 else f"{i}" * 150, 1, 2) for i in range(1, 90)] + [(7, "u", "h" * 200, 1, 2)] * 25
    monkeypatch.setattr(warc, "COPIES", 4)
    for groups in (2, 1000):
        monkeypatch.setattr(warc, "HOT_GROUPS", groups)
        assert result(warc.archived(spark.createDataFrame(rows, COLUMNS))) == want(rows)


def test_every_range_owns_the_records_that_start_in_it(tmp_path):
    rng = random.Random(1)
    members, at = [], []
    for i in range(40):
        at.append(sum(map(len, members)))
        body = rng.randbytes(rng.choice([10, 300, 900]))
        if i % 7 == 0:
            body += gzip.compress(b"no record") + warc.MAGIC * 3  # magic inside payloads is no record
        members.append(warc.member([("WARC-Type", "resource"), ("WARC-Record-ID", f"<{i}>")], body, level=0 if i % 2 else 6))
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(members))
    size = path.stat().st_size
    for split in (1, 13, 1000, size):
        with open(path, "rb") as f:
            data = warc.Bytes(f, size)
            found = [(o, r["record_id"], r["error"]) for a in range(0, size, split) for o, r in warc.records_of(data, a, min(size, a + split))]
        assert found == [(o, f"<{i}>", None) for i, o in enumerate(at)]


def test_damage_is_reported_and_passed(tmp_path):
    rng = random.Random(2)
    members = [warc.page_member(i, "u", hashlib.sha256(b := rng.randbytes(500)).hexdigest(), 500, b, 0, None) for i in range(5)]
    broken = bytearray(members[1])
    broken[300] ^= 0xFF
    wrong = warc.page_member(9, "u", "0" * 64, 3, b"abc", 0, None)
    data = members[0] + bytes(broken) + b"junk" + members[2] + wrong + members[3] + members[4][:-200]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(data)
    with open(path, "rb") as f:
        found = [(r["id"], r["error"] is None, r["error"]) for _, r in warc.records_of(warc.Bytes(f, len(data)), 0, len(data))]
    assert [x[:2] for x in found] == [("0", True), ("1", False), ("2", True), ("9", False), ("3", True), ("4", False)]
    assert found[3][2] == "digest" and found[5][2] == "cut short"


def test_empty_table(spark):
    assert warc.archived(spark.createDataFrame([], COLUMNS)).count() == 0
