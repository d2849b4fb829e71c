import gzip
import hashlib
import random
from collections import Counter

import pytest

from readprep.llm import common, warc

SCHEMA = "page_id long, url string, html string, size long, record_type string"


@pytest.fixture
def pages(spark):
    big = "<p>" + "x" * 200 + "</p>"
    rows = [(1, "http://b.org/x?q=1", big), (2, "http://www.a.com/", big), (3, None, big), (4, "bad url\n[", ""), (5, "http://a.com/é", None), (6, "http://a.com/z", "tiny"), (7, "http://a.com/z", "tiny")]
    rows += [(8, "https://[bad", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 9), (9, "http://c.net", "日本é😀" * 50), (None, "http://c.net", big), (10, "http://c.net", "line\r\n\r\n" * 30), (1, "http://b.org/x?q=1", big)]
    return spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA)


def test_round_trip(pages, tmp_path):
    got = warc.archive(pages, f"file://{tmp_path}/a").collect()
    source = pages.collect()
    assert Counter((r["page_id"], r["payload_bytes"]) for r in got) == Counter((r["page_id"], len((r["html"] or "").encode())) for r in source)
    kind = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got}
    assert kind[2] == ("revisit", 1) and kind[3] == ("revisit", 1) and kind[1] == kind[None] == kind[6] == kind[7] == kind[5] == ("response", None)
    order = sorted(got, key=lambda r: r["index_position"])
    assert [r["index_position"] for r in order] == list(range(len(order)))
    keys = [(r["url_key"], r["timestamp"], -(1 << 63) if r["page_id"] is None else r["page_id"], r["archive"], r["position"]) for r in order]
    assert keys == sorted(keys)
    # the files are archives of their own
    for f in (tmp_path / "a").glob("part-*"):
        for h, block, _ in warc.parse(gzip.open(f).read()):
            assert len(block) == int(h["content-length"]) and (h["warc-type"] == "response") == ("warc-refers-to" not in h)
    # an index entry leads to its record alone
    for r in got:
        with open(r["archive"].removeprefix("file:").replace("///", "/"), "rb") as f:
            f.seek(r["position"])
            (h, block, _), = warc.parse(gzip.decompress(f.read(r["size"])))
        assert warc._page(h["warc-record-id"]) == r["page_id"] and (r["record_type"] == "revisit" or hashlib.sha256(block).hexdigest() == r["payload_digest"])


def test_files_are_bounded_by_bytes(spark, tmp_path):
    """Records of very different sizes, one very long; ranges are merged from many runs."""
    rng = random.Random(2)
    rows = [(i, f"http://h{i % 7}.org/{rng.randint(0, 50)}", "".join(chr(rng.randint(33, 1000)) for _ in range(rng.choice([10, 300, 2000])))) for i in range(300)]
    rows.append((300, "http://h1.org/long", "".join(map(str, range(300_000)))))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = f"file://{tmp_path}/b"
    warc.write(warc.records(pages), path, 20_000)
    sizes = [f.stat().st_size for f in (tmp_path / "b").glob("part-*")]
    assert len(sizes) > 10 and sorted(sizes)[-2] < 30_000
    for ranges in (1, 5):
        got = sorted(warc.merge(warc.read(spark, path), ranges).collect(), key=lambda r: r["index_position"])
        assert [(r["url_key"], r["timestamp"], r["page_id"]) for r in got] == sorted((warc.url_key(u), r, i) for i, u, r in ((i, u, {g["page_id"]: g["timestamp"] for g in got}[i]) for i, u, _ in rows))
        assert {r["page_id"]: r["payload_bytes"] for r in got} == {i: len(t.encode()) for i, _, t in rows}


def test_hot_payloads_and_urls(spark, tmp_path, monkeypatch):
    """One payload, one URL and null page_ids of most rows: dealt out, and still one order."""
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    monkeypatch.setattr(warc, "RANGE", 10)
    rows = [(None if i % 3 == 0 else i, "http://a.org/", "y" * 150 if i % 2 else "") for i in range(90)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = warc.archive(pages, f"file://{tmp_path}/h").collect()
    assert sorted(r["index_position"] for r in got) == list(range(90))
    assert Counter((r["record_type"], r["refers_to"]) for r in got if r["page_id"] is not None and r["payload_bytes"]) == {("response", None): 1, ("revisit", 1): 29}
    assert all(r["record_type"] == "response" for r in got if not r["payload_bytes"])


def test_broken_archives():
    ok = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert [(b, at) for _, b, at in warc.parse(ok * 2)] == [(b"ab", 0), (b"ab", len(ok))]
    data = warc.member(ok) + warc.member(b"") + warc.member(ok)
    assert [m[0] for m in warc.members(data)] == [ok, ok] and [gzip.decompress(data[at : at + n]) for _, at, n in warc.members(data)] == [ok, ok]
    with pytest.raises(ValueError, match="no end"):
        list(warc.members(data[:-3]))
    for bad in (ok[:-2], b"x" + ok, ok.replace(b": 2", b": 3")):
        with pytest.raises(ValueError, match="byte"):
            list(warc.parse(bad))


def test_loser_tree_sorts():
    rng = random.Random(1)
    for k in range(9):
        runs = [sorted((rng.randint(0, 5), rng.randint(0, 9)) for _ in range(rng.randint(0, 12))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert [warc.url_key(u) for u in ("http://www.Example.com/A?b=C", "https://m.x.org", "urn:none")] == ["com,example)/a?b=c", "org,x,m)/", "urn:none"]


def test_no_pages(pages, tmp_path):
    assert warc.archive(pages.filter("false"), f"file://{tmp_path}/e").count() == 0


def test_query_equals_sql(spark, small, duck):
    from readprep.llm.queries import ORACLES

    got = warc.op8(spark, small)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(r.values())) for r in duck.sql(ORACLES["op8_warc"]).to_arrow_table().select(got.columns).to_pylist())
