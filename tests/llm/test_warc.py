import base64
import gzip
import hashlib
import random
from functools import partial
from pathlib import Path

import pytest
from sluice.llm import common, warc
from sluice.llm.queries import op13_warc

LONG = "<p>one text of more than a hundred bytes that stands on several pages</p>" * 3
ROWS = [
    (5, "http://a/5", LONG), (3, "http://a/3", LONG), (9, None, LONG), (1, "http://a/1 x\r\ny", "short"), (2, "http://a/2", "short"), (4, "http://a/4", None), (6, "http://a/6", ""),
    (7, "http://a/7", "x" * 99), (8, "http://a/8", "x" * 99), (10, "u", "é" * 50), (11, "u", "é" * 50), (12, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 5), (None, "u", LONG), (None, "u", "lone " * 40), (13, "u", LONG), (13, "u", LONG), (3, "u", "other " * 30),
]


def plain(rows):
    first = {}
    for i, _, html in rows:
        key = (html or "").encode()
        if i is not None:
            first[key] = min(i, first.get(key, i))
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        later = len(body) >= 100 and body in first and i != first[body]
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if later else "response", first[body] if later else None))
    return sorted(map(repr, out))


def pages(spark, rows):
    return spark.createDataFrame([(*r, "k", b"p", 1) for r in rows], "page_id long, url string, html string, digest string, payload binary, first int")


@pytest.mark.parametrize("level", [6, None])
def test_round_trip(spark, level, monkeypatch):
    want = plain(ROWS)
    assert sorted(repr(tuple(r)) for r in warc.round_trip(pages(spark, ROWS), level).collect()) == want
    monkeypatch.setattr(warc, "is_small", lambda df: False)
    monkeypatch.setattr(warc, "meet", partial(common.meet, small=0, hot=3))
    monkeypatch.setattr(warc, "HOT", 3)
    assert sorted(repr(tuple(r)) for r in warc.round_trip(pages(spark, ROWS), level).collect()) == want
    assert warc.round_trip(pages(spark, []), level).count() == 0


def test_query_on_driver_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    assert sorted(repr(tuple(r)) for r in op13_warc(spark, "/root/testdata/sf0.001").collect()) == plain(rows)


def test_sql_agrees(spark, tmp_path):
    import duckdb

    pages(spark, ROWS).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    cursor = con.execute(warc.ORACLE)
    assert [d[0] for d in cursor.description] == op13_warc(spark, str(tmp_path)).columns
    assert sorted(map(repr, cursor.fetchall())) == plain(ROWS)


def archive(spark, tmp_path, rows, level):
    path = f"{tmp_path}/{level}"
    warc.write(pages(spark, rows).coalesce(1), path, level)
    return path, next(Path(path).glob("part-*"))


def test_archives_are_plain_gzip_and_sound(spark, tmp_path):
    path, file = archive(spark, tmp_path, ROWS, 6)
    content = gzip.decompress(file.read_bytes())
    assert content.count(b"WARC-Record-ID") == len(ROWS) and b"WARC-Target-URI: http://a/1%20x%0D%0Ay\r\n" in content
    found = list(warc.salvage(file.read_bytes()))
    assert len(found) == len(ROWS) and found[-1].end == file.stat().st_size and all(a.end == b.start for a, b in zip(found, found[1:], strict=False))
    whole = list(warc.salvage(gzip.compress(content)))  # all records in one member
    assert [r.block for r in whole] == [r.block for r in found] and [r.block for r in warc.salvage(content)] == [r.block for r in found]
    assert warc.gaps(spark, path).count() == 0
    read = warc.read(spark, path).where("type = 'revisit'").first()
    assert read.payload == b"" and read.refers_to.startswith(warc.URN) and read.payload_digest == "sha256:" + hashlib.sha256(LONG.encode()).hexdigest()


@pytest.mark.parametrize("level", [6, None])
def test_salvage_of_damaged_archives(spark, tmp_path, level):
    rng = random.Random(level)
    rows = [(i, f"http://h/{i}", "".join(rng.choice("abcdef <>\n") for _ in range(rng.randrange(50, 900)))) for i in range(40)]
    rows[20] = (20, "u", "text\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc")
    _, file = archive(spark, tmp_path, rows, level)
    good = file.read_bytes()
    sound = list(warc.salvage(good))
    assert len(sound) == 40
    for trial in range(60):
        bad = bytearray(good)
        a = rng.randrange(len(bad))
        b = min(len(bad), a + rng.choice([1, 1, 5, 300]))
        kind = trial % 4
        if kind == 0:
            bad[a:b] = bytes(x ^ 0x55 for x in bad[a:b])
        elif kind == 1:
            del bad[a:b]
        elif kind == 2:
            bad[a:a] = rng.randbytes(b - a)
        else:
            del bad[a:]
        hit = len(good) if kind == 3 else b
        found = list(warc.salvage(bytes(bad)))
        records = [r for r in found if isinstance(r, warc.Record)]
        holes = [g for g in found if isinstance(g, warc.Gap)]
        untouched = [r.block for r in sound if r.end <= a or (r.start >= hit and kind != 2) or (kind == 2 and r.start >= a)]
        blocks = [r.block for r in records]
        assert all(x in blocks for x in untouched)
        spans = sorted((x.start, x.end) for x in found)  # records and gaps cover the whole file, without overlap
        assert spans[0][0] == 0 and spans[-1][1] == len(bad) and all(p[1] == q[0] for p, q in zip(spans, spans[1:], strict=False)) or kind == 3 and not bad
        assert holes or kind in (1, 3) or len(records) == 40
        assert all(g.end > g.start and g.reason for g in holes)


def test_damage_is_logged_by_file_and_place(spark, tmp_path):
    path, file = archive(spark, tmp_path, ROWS, 6)
    data = bytearray(file.read_bytes())
    third = list(warc.salvage(bytes(data)))[2]
    data[(third.start + third.end) // 2] ^= 0xFF
    file.write_bytes(bytes(data))
    for crc in Path(path).glob(".*.crc"):
        crc.unlink()
    log = warc.gaps(spark, path).collect()
    assert [(g.start, g.end) for g in log] == [(third.start, third.end)] and log[0].file.endswith(file.name) and log[0].damage
    assert warc.read(spark, path).where("damage IS NULL").count() == len(ROWS) - 1


def test_records_beyond_one_member(monkeypatch):
    body = bytes(random.Random(4).randrange(256) for _ in range(5000))
    monkeypatch.setattr(warc, "MEMBER", 700)
    one = b"".join(p + b"\0" for p in warc.packed(warc.record(body, hashlib.sha256(body).hexdigest(), "urn:a", "u", None, "d"), 6))
    two = list(warc.salvage(one + one))
    assert [r.payload for r in two] == [body, body] and two[1].start == len(one) and two[1].end == 2 * len(one)
    cut = list(warc.salvage(one[: len(one) // 2] + one))
    assert [r.payload for r in cut if isinstance(r, warc.Record)] == [body] and isinstance(cut[0], warc.Gap)


def test_checks():
    body = b"x" * 200
    good = warc.record(body, hashlib.sha256(body).hexdigest(), "urn:a", "u", None, "d")
    assert [r.payload for r in warc.salvage(good)] == [body] and list(warc.salvage(b"")) == []
    for bad in (good.replace(b"Content-Length: 2", b"Content-Length: 9"), good.replace(b"xx", b"xy"), good[:-1], good[:5], b"junk", good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"WARC-Type: r", b"WARC Type r")):
        found = list(warc.salvage(bad))
        assert [type(x) for x in found] == [warc.Gap] and (found[0].start, found[0].end) == (0, len(bad))
    for value in (hashlib.sha1(body).hexdigest(), base64.b32encode(hashlib.sha1(body).digest()).decode()):
        stated = good.replace(b"sha256:" + hashlib.sha256(body).hexdigest().encode(), b"sha1:" + value.encode(), 1)
        assert [r.payload for r in warc.salvage(stated)] == [body]
        assert [type(x) for x in warc.salvage(stated.replace(b"sha1:" + value[:3].encode(), b"sha1:222"))] == [warc.Gap]
