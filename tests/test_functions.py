"""Golden values of the row functions."""

import pytest
from pyspark.sql import functions as F

from marquee.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


L = F.lit


@pytest.mark.parametrize(
    "name,title,year",
    [("Inception (2010)", "Inception", 2010), ("Inception.2010.1080p", "Inception", 2010), ("Inception", "Inception", None), ("1917.2019.1080p", "", 1917), ("Foo (_2010", "Foo (", 2010), ("a_12010.x", "a 1", 2010)],
)
def test_clean_title(spark, name, title, year):
    assert value(spark, T.clean_title(L(name))) == title and value(spark, T.year(L(name))) == year


@pytest.mark.parametrize("name,want", [("Show.s01E02.mkv", (1, 2)), ("1920x1080", (1920, 1080)), ("S99999999999E1", (0, 1)), ("nope.mkv", (0, 0)), ("3x04 S05E06", (5, 6))])
def test_season_episode(spark, name, want):
    assert (value(spark, T.season(L(name))), value(spark, T.episode(L(name)))) == want


@pytest.mark.parametrize("title,want", [("the Office", "office"), ("An Ant", "ant"), ("Theory", "theory"), ("A É", "É"), ("A", "a")])
def test_title_key(spark, title, want):
    assert value(spark, T.title_key(L(title))) == want


@pytest.mark.parametrize("n,want", [(1023, "1023 B"), (1024, "1.0 KB"), (1048576, "1.0 MB"), (1073741824, "1.00 GB"), (1 << 40, "1.00 TB")])
def test_bytes(spark, n, want):
    assert value(spark, T.format_bytes(L(n))) == want


@pytest.mark.parametrize("s,want", [(3661.5, "01:01:01.500"), (-1.0, "00:00:00.000"), (0.9999, "00:00:00.999"), (360000.0, "100:00:00.000")])
def test_vtt_time(spark, s, want):
    assert value(spark, T.vtt_time(L(s))) == want


def test_vtt_cues(spark):
    body = "WEBVTT\r\n\r\n1\n00:01.500 --> 00:00:03.000\nHello\nthere\n\nNOTE x\n\n00:05.000 --> 00:06.000\n  \n"
    assert [tuple(c) for c in value(spark, T.vtt_cues(L(body)))] == [(1.5, 3.0, "Hello\nthere")]


@pytest.mark.parametrize("h,want", [("bytes=-10", (90, 99)), ("bytes=95-200", (95, 99)), ("bytes=100-", None), ("bytes=5-", (5, 99)), ("bytes=9-3", None)])
def test_byte_range(spark, h, want):
    got = value(spark, T.byte_range(L(h), L(100)))
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("w,h,want", [(3840, 2160, 150), (1920, 1080, 120), (1280, 720, 93), (7680, 4320, 156)])
def test_hevc_level(spark, w, h, want):
    assert value(spark, T.hevc_level(L(w), L(h), L(30))) == want


@pytest.mark.parametrize(
    "line,want",
    [("Dialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,{\\i1}Hi\\Nyou\\hthere{open", "Hi\nyou there"), ("comment: 1,2,3,4,5,6,7,8,9,x,y", "x,y"), ("0,0,Default,,0,0,0,,text, more", "text, more"), ("plain, text", "plain, text"), ("a\\{x}N", "a\\N")],
)
def test_clean_ass(spark, line, want):
    assert value(spark, T.clean_ass(L(line))) == want


def test_small_ones(spark):
    assert value(spark, T.percent_encode(L("a b*~é"))) == "a%20b%2A~%C3%A9"
    assert value(spark, T.escape_js(L("\\'<\n"))) == "\\\\\\'\\u003c\\n"
    assert value(spark, T.render(L("__A____B__ __C__ __A"), {"A": L("__B__"), "B": L("2")})) == "__B__2 __C__ __A"
    assert value(spark, T.cookie(L("a=1; session=xyz; session=2"))) == "xyz"
    assert value(spark, T.without_extension(L(".hidden"))) == ".hidden" and value(spark, T.without_extension(L("a.b.mkv"))) == "a.b"
    assert value(spark, T.query_int(L("http://x/?a=1&page=7&page=8"), "page")) == 7 and value(spark, T.query_int(L("http://x/?page=z&page=8"), "page")) is None
    assert value(spark, T.track_label(L(""), L("en"), L("Track 1"), L(True))) == "en (Forced)"
    assert value(spark, T.hevc_codec(L(7), L(120), L(176))) == "hev1.2.4.L120.B0"
    assert [value(spark, T.proxy_port(L(u))) for u in ("socks5://h", "https://h", "http://h:81", "h")] == [1080, 443, 81, 80]
    assert value(spark, T.initial(L(""))) == "U" and value(spark, T.content_type(L("A.MKV"))) == "video/x-matroska"
    header = lambda n, v: F.struct(L(n).alias("name"), L(v).alias("value"))
    assert value(spark, T.client_ip(F.array(header("Host", "h")))) == "127.0.0.1"
    assert value(spark, T.client_ip(F.array(header("Host", "h"), header("X-Real-IP", "1.2.3.4"), header("x-forwarded-for", "5.6.7.8")))) == "1.2.3.4"


@pytest.mark.parametrize("url,want", [("socks5://h", ("socks5h", "h", 1080)), ("socks4://h/", ("http", "h", 80)), ("https://u:p@h.org:8443/x", ("http", "h.org", 8443)), ("http://h/a:9", ("http", "h", 80))])
def test_proxy(spark, url, want):
    assert (value(spark, T.proxy_kind(L(url))), value(spark, T.proxy_host(L(url))), value(spark, T.proxy_port(L(url)))) == want


def test_encode_path(spark):
    assert value(spark, T.encode_path(L("a b%20#?&\"<>'é/c"))) == "a%20b%2520%23%3F%26%22%3C%3E%27é/c"
