import gzip
import random
import zlib

import pytest

from compare import duck, rows_of
from twinfold.llm import warc
from twinfold.llm.common import new_path


def test_both_versions_round_trip():
    for version in (1, 2):
        data = warc.arc_head(version, "x.arc") + warc.arc_record(version, "http://a/b c", b"HTTP/1.0 200 OK\r\n\r\nhi\n", "x.arc") + warc.arc_record(version, "dns:a", b"", "x.arc", mime="text/dns")
        one, two = warc.parse_arc(data + data[:0])
        assert (one["URL"], one["version"], one["body"]) == ("http://a/b%20c", version, b"HTTP/1.0 200 OK\r\n\r\nhi\n")
        assert (warc.to_warc(one)["payload"], warc.to_warc(one)["type"], warc.to_warc(two)["type"]) == (b"hi\n", "response", "resource")
        assert warc.to_warc(one) == warc.to_warc(next(warc.parse_arc(data)))


def test_blank_in_a_legacy_address_and_short_date():
    data = warc.arc_head(1, "x") + b"http://a/b c 1.2.3.4 199901 text/html 2\nok\n"
    r = warc.to_warc(next(warc.parse_arc(data)))
    assert (r["url"], r["date"], r["ip"]) == ("http://a/b c", "1999-01-01T00:00:00Z", "1.2.3.4")


@pytest.mark.parametrize("bad", [b"http://a 1.2.3.4 20200101000000 text/html 9\nshort", b"no length x\n", b"a b 3\nabc"])
def test_damage_is_reported(bad):
    with pytest.raises(ValueError):
        list(warc.parse_arc(warc.arc_head(1, "x") + bad))
    with pytest.raises(ValueError):
        list(warc.parse_arc(bad))


def test_unpack_members():
    assert warc.unpack(gzip.compress(b"ab") + gzip.compress(b"cd")) == b"abcd"
    long = bytes(random.Random(1).randbytes(100_000))
    assert warc.unpack(gzip.compress(long) + gzip.compress(b"") + gzip.compress(long[:5])) == long + long[:5]
    assert warc.unpack(b"plain") == b"plain"
    with pytest.raises(ValueError, match="cut"):
        warc.unpack(gzip.compress(long)[:-9])


def test_revisits_nulls_and_repeats(spark):
    rows = [(5, "http://a/1", "same"), (3, "http://a/2", "same"), (3, "http://a/2", "same"), (9, None, "same"), (1, "http://b", None), (2, "http://c d", ""), (4, "http://e", "Ünï\r\n\r\nWARC/1.0\n"), (None, "http://n", "same"), (7, "x", "lone")]
    arc, out = new_path(spark, "t-arc"), new_path(spark, "t-warc")
    warc.pages_to_arc(spark.createDataFrame(rows, "page_id long, url string, html string"), arc)
    warc.arc_to_warc(spark, arc, out)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_warc(spark, out).collect()), key=str)
    dig = lambda s: warc.digest(s.encode())
    want = [(5, "revisit", 3, 4, dig("same")), (3, "response", None, 4, dig("same")), (3, "response", None, 4, dig("same")), (9, "revisit", 3, 4, dig("same")), (1, "response", None, 0, dig("")), (2, "revisit", 1, 0, dig("")), (4, "response", None, 18, dig("Ünï\r\n\r\nWARC/1.0\n")), (None, "revisit", 3, 4, dig("same")), (7, "response", None, 4, dig("lone"))]
    assert got == sorted(want, key=str)


def test_no_pages(spark):
    arc, out = new_path(spark, "t-arc"), new_path(spark, "t-warc")
    warc.pages_to_arc(spark.createDataFrame([], "page_id long, url string, html string"), arc)
    warc.arc_to_warc(spark, arc, out)
    assert warc.read_warc(spark, out).count() == 0


def test_both_versions_are_converted_in_one_run_and_members_stand_alone(spark, sf_dir):
    """The query's own path on a table: odd ids in version 1, even ones in version 2; a record a gzip member."""
    arc, out = new_path(spark, "t-arc"), new_path(spark, "t-warc")
    warc.pages_to_arc(spark.read.parquet(f"{sf_dir}/pages.parquet"), arc)
    facts = warc.arc_facts(spark, arc).select("version", "page_id").collect()
    assert {(r.version, r.page_id % 2) for r in facts} == {(1, 1), (2, 0)}
    warc.arc_to_warc(spark, arc, out)
    for path in (arc, out):
        content = bytes(warc.read_archive(spark, path).first().content)
        assert gzip.decompress(content) == warc.unpack(content)
        z = zlib.decompressobj(31)
        assert z.decompress(content).startswith((b"filedesc://", b"WARC/1.0\r\nWARC-Type: warcinfo"))
        z2 = zlib.decompressobj(31)
        one = z2.decompress(z.unused_data)
        assert len(list(warc.parse_warc(one))) == 1 if path == out else one.count(b"X-Page-Id") == 1


def test_very_long_pages_clashing_columns_and_shuffled_revisits(spark, monkeypatch):
    monkeypatch.setattr(warc, "MAX_BROADCAST_PAYLOADS", 0)
    long = "<p>" + "long text " * 600_000
    rows = [(1, "http://a", long, "x", b"y"), (2, "http://b", long, "x", b"y"), (3, "http://c", "short", "x", b"y"), (None, "http://d", "lone", "x", b"y"), (None, "http://e", "lone", "x", b"y")]
    arc, out = new_path(spark, "t-arc"), new_path(spark, "t-warc")
    warc.pages_to_arc(spark.createDataFrame(rows, "page_id long, url string, html string, value string, content binary"), arc)
    warc.arc_to_warc(spark, arc, out)
    got = {(r.url, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_warc(spark, out).collect()}
    assert got == {("http://a", "response", None, len(long)), ("http://b", "revisit", 1, len(long)), ("http://c", "response", None, 5), ("http://d", "response", None, 4), ("http://e", "response", None, 4)}


def test_query_equals_sql(spark, sf_dir):
    assert rows_of(warc.op3_warc(spark, sf_dir).toPandas()) == rows_of(duck(sf_dir).sql(warc.OP3_SQL).df())
