"""Row functions over names, paths, times and markup: Column -> Column, all inside generated code (no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
VIDEO_SUFFIXES = (".mkv", ".mp4", ".avi", ".ts", ".webm", ".mov")
CONTENT_TYPES = {".mkv": "video/x-matroska", ".mp4": "video/mp4", ".webm": "video/webm", ".avi": "video/x-msvideo", ".mov": "video/quicktime", ".ts": "video/mp2t"}
SEASON_EPISODE = "[Ss]([0-9]+)[Ee]([0-9]+)"
CROSS = "([0-9]+)[xX]([0-9]+)"
YEAR = "(1[89][0-9][0-9]|20[0-9][0-9]|2100)"
ARTICLES = ("The ", "A ", "An ")
IMAGE_BASE = "https://image.tmdb.org/t/p/"
API_BASE = "https://api.themoviedb.org/3/"


def is_video(name: Column) -> Column:
    return name.rlike("(" + "|".join(s.replace(".", r"\.") for s in VIDEO_SUFFIXES) + ")$")


def without_extension(name: Column) -> Column:
    """Drops what follows the last dot; a name that only begins with a dot keeps it."""
    return F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")


def _number(text: Column) -> Column:
    """A number that does not fit an int is 0."""
    return F.coalesce(F.nullif(text, F.lit("")).try_cast("int"), F.lit(0))


def _numbered(name: Column, group: int) -> Column:
    return F.when(name.rlike(SEASON_EPISODE), _number(F.regexp_extract(name, SEASON_EPISODE, group))).when(name.rlike(CROSS), _number(F.regexp_extract(name, CROSS, group))).otherwise(0)


def season(name: Column) -> Column:
    return _numbered(name, 1)


def episode(name: Column) -> Column:
    return _numbered(name, 2)


def year(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, YEAR, 1), F.lit("")).cast("int")


def clean_title(name: Column) -> Column:
    found = F.regexp_extract(name, YEAR, 1)
    before = F.when(found != "", F.regexp_replace(name.substr(F.lit(1), F.instr(name, found) - 1), r"[ .(\[\-]+$", "")).otherwise(name)
    return F.translate(F.regexp_replace(F.regexp_replace(before, r"^[ \t\r\n.\-_]+", ""), r"[ \t\r\n.\-_]+$", ""), "._", "  ")


def ascii_lower(text: Column) -> Column:
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def title_key(title: Column) -> Column:
    """Sort key: without a leading article, ASCII letters folded."""
    out = title
    for a in reversed(ARTICLES):
        out = F.when(ascii_lower(title).startswith(a.lower()), title.substr(F.lit(len(a) + 1), F.length(title))).otherwise(out)
    return ascii_lower(out)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


BYTE_UNITS = (("TB", 40, 2), ("GB", 30, 2), ("MB", 20, 1), ("KB", 10, 1))


def byte_unit(n: Column) -> Column:
    out = F.lit("B")
    for unit, bits, _ in reversed(BYTE_UNITS):
        out = F.when(n >= 1 << bits, unit).otherwise(out)
    return out


def byte_value(n: Column) -> Column:
    """The number that stands before byte_unit()."""
    out = n.cast("double")
    for _, bits, digits in reversed(BYTE_UNITS):
        out = F.when(n >= 1 << bits, F.round(n / float(1 << bits), digits)).otherwise(out)
    return out


def format_bytes(n: Column) -> Column:
    out = F.format_string("%d B", n.cast("long"))
    for unit, bits, digits in reversed(BYTE_UNITS):
        out = F.when(n >= 1 << bits, F.format_string(f"%.{digits}f {unit}", n / float(1 << bits))).otherwise(out)
    return out


def vtt_time(seconds: Column) -> Column:
    """HH:MM:SS.mmm, milliseconds cut off; negative times are 0."""
    ms = F.floor(F.greatest(seconds, F.lit(0.0)) * 1000)
    pad = lambda x, n: F.lpad(F.floor(x).cast("string"), n, "0")
    hours = F.floor(ms / 3600000).cast("string")
    return F.concat(F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours), F.lit(":"), pad(ms / 60000 % 60, 2), F.lit(":"), pad(ms / 1000 % 60, 2), F.lit("."), pad(ms % 1000, 3))


def parse_vtt_time(text: Column) -> Column:
    """Seconds of two or three fields; anything else is 0."""
    parts = F.transform(F.split(text, ":"), lambda p: p.try_cast("double"))
    at = lambda i: F.get(parts, F.lit(i))
    return F.coalesce(F.when(F.size(parts) == 3, at(0) * 3600 + at(1) * 60 + at(2)).when(F.size(parts) == 2, at(0) * 60 + at(1)), F.lit(0.0))


def vtt_cues(body: Column) -> Column:
    """Cues (start, end, text) of a WebVTT text; blocks without a time line or text are dropped."""
    blocks = F.filter(F.split(F.regexp_replace(body, "\r\n?", "\n"), r"\n\n+"), lambda b: b.contains("-->"))
    cue = lambda b: F.struct(
        parse_vtt_time(F.regexp_extract(b, r"(?m)^([0-9:.]+) +-->", 1)).alias("start"), parse_vtt_time(F.regexp_extract(b, r"(?m)--> +([0-9:.]+)", 1)).alias("end"), F.regexp_replace(F.regexp_extract(b, r"-->[^\n]*\n(?s)(.*)$", 1), r"^\s+|\s+$", "").alias("text")
    )
    return F.filter(F.transform(blocks, cue), lambda c: c["text"] != "")


def clean_ass(line: Column) -> Column:
    """Visible text of an ASS subtitle event: fields, override blocks and escapes removed in one pass over tokens."""
    t = F.regexp_replace(F.regexp_replace(line, r"^[ \t\r\n]+", ""), r"[ \t\r\n]+$", "")
    nine, eight = r"^(?:[^,]*,){9}", r"^(?:[^,]*,){8}"
    head = F.regexp_extract(t, eight, 0)
    bare = head.contains("Default") | head.contains("0,0,0") | head.contains("0:00:")
    event = r"(?i)^(?:dialogue|comment):[ \t]*"  # goes also where fewer than nine commas follow
    u = F.when(t.rlike(event), F.regexp_replace(F.regexp_replace(t, event, ""), nine, "")).when(bare, F.regexp_replace(t, eight, "")).otherwise(t)
    tokens = F.regexp_extract_all(u, F.lit(r"(?s)\{[^}]*(?:\}|$)|\\[NnhH]|."), F.lit(0))
    out = F.transform(tokens, lambda x: F.when(x.startswith("{"), "").when(x.isin("\\N", "\\n"), "\n").when(x.isin("\\h", "\\H"), " ").otherwise(x))
    return F.array_join(out, "")


def cue_end(start: Column, duration: Column) -> Column:
    return start + F.when(F.coalesce(duration, F.lit(0.0)) <= 0, F.lit(3.0)).otherwise(duration)


def percent_encode(text: Column) -> Column:
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _replaced(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_html(text: Column) -> Column:
    return _replaced(text, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")))


def escape_js(text: Column) -> Column:
    return _replaced(text, (("\\", "\\\\"), ('"', '\\"'), ("'", "\\'"), ("<", "\\u003c"), (">", "\\u003e"), ("\n", "\\n"), ("\r", "\\r")))


def escape_json(text: Column) -> Column:
    return _replaced(text, (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")))


def query_param(url: Column, name: str) -> Column:
    """Text of the first name=value after the first question mark; null if there is none."""
    query = url.substr(F.instr(url, "?") + 1, F.length(url))
    hits = F.filter(F.split(query, "&"), lambda p: p.startswith(name + "="))
    return F.when(F.instr(url, "?") > 0, F.substring(F.get(hits, F.lit(0)), len(name) + 2, 1 << 30))


def query_int(url: Column, name: str) -> Column:
    value = query_param(url, name)
    return F.when(value.rlike("^[+-]?[0-9]+$"), value.try_cast("long"))


def minutes(seconds: Column) -> Column:
    whole = F.floor(seconds)
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def byte_range(header: Column, size: Column) -> Column:
    """(first, last) of a Range header over `size` bytes; null where it cannot be satisfied."""
    a, b = (F.regexp_extract(header, "^bytes=([0-9]*)-([0-9]*)$", k).try_cast("long") for k in (1, 2))
    first = F.when(a.isNull() & b.isNotNull(), F.greatest(size - b, F.lit(0))).otherwise(F.coalesce(a, F.lit(0)))
    last = F.when(a.isNull() | b.isNull(), size - 1).otherwise(F.least(b, size - 1))
    return F.when((first <= last) & (first < size), F.struct(first.cast("long").alias("first"), last.cast("long").alias("last")))


def hevc_level(width: Column, height: Column, reported: Column) -> Column:
    area = width * height
    return F.greatest(F.when(area > 8912896, 156).when(area > 2228224, 150).when(area > 983040, 120).otherwise(93), reported)


def hevc_codec(profile: Column, level: Column, constraint: Column) -> Column:
    p = F.when(profile.between(1, 3), profile).otherwise(2)
    compat = F.when(p == 1, 6).when(p == 2, 4).otherwise(1)
    return F.format_string("hev1.%d.%d.L%d.%02X", p.cast("int"), compat, level.cast("int"), constraint.cast("int"))


def track_label(title: Column, language: Column, default: Column, forced: Column) -> Column:
    label = F.coalesce(F.nullif(title, F.lit("")), F.nullif(language, F.lit("")), default)
    return F.when(forced & ~F.lower(label).contains("forced"), F.concat(label, F.lit(" (Forced)"))).otherwise(label)


def search_url(kind: str, query: Column, year_: Column) -> Column:
    key = "primary_release_year" if kind == "movie" else "first_air_date_year"
    return F.concat(F.lit(f"{API_BASE}search/{kind}?query="), percent_encode(query), F.when(year_.isNotNull(), F.concat(F.lit(f"&{key}="), year_.cast("string"))).otherwise(F.lit("")))


def image_url(path: Column, size: str = "w500") -> Column:
    return F.concat(F.lit(IMAGE_BASE + size), path)


def cookie(header: Column, name: str = "session") -> Column:
    hits = F.filter(F.split(header, "; "), lambda p: p.startswith(name + "="))
    return F.substring(F.get(hits, F.lit(0)), len(name) + 2, 1 << 30)


def initial(name: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) == "", "U").otherwise(F.upper(F.substring(name, 1, 1)))


def content_type(path: Column) -> Column:
    out = F.lit("application/octet-stream")
    for suffix, kind in CONTENT_TYPES.items():
        out = F.when(F.lower(path).endswith(suffix), kind).otherwise(out)
    return out


def render(template: Column, values: dict[str, Column]) -> Column:
    """__KEY__ marks replaced in one pass; unknown marks stay, values are not scanned again."""
    tokens = F.regexp_extract_all(template, F.lit(r"(?s)__[A-Z0-9]+(?:_[A-Z0-9]+)*__|."), F.lit(0))

    def value(x: Column) -> Column:
        out = x
        for key, v in values.items():
            out = F.when(x == f"__{key}__", v).otherwise(out)
        return out

    return F.array_join(F.transform(tokens, value), "")


#: The characters of a path that an attribute cannot hold; the percent sign goes first.
PATH_ESCAPES = (("%", "%25"), (" ", "%20"), ("#", "%23"), ("?", "%3F"), ("&", "%26"), ('"', "%22"), ("<", "%3C"), (">", "%3E"), ("'", "%27"))
IP_HEADERS = ("x-forwarded-for", "x-real-ip")
SOCKS = ("socks5", "socks5h", "socks")


def encode_path(path: Column) -> Column:
    return _replaced(path, PATH_ESCAPES)


def client_ip(headers: Column) -> Column:
    """Value of the first address header of an array of (name, value); the local address if there is none."""
    hits = F.filter(headers, lambda h: F.lower(h["name"]).isin(*IP_HEADERS))
    return F.coalesce(F.get(hits, F.lit(0))["value"], F.lit("127.0.0.1"))


def proxy_kind(url: Column) -> Column:
    return F.when(F.regexp_extract(url, "^([A-Za-z0-9]+)://", 1).isin(*SOCKS), "socks5h").otherwise("http")


def proxy_host(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z0-9]+://(?:[^/?#]*@)?([^/?#:]+)", 1)


def proxy_port(url: Column) -> Column:
    """The port that the URL names, else that of its scheme."""
    own = F.regexp_extract(url, "^(?:[A-Za-z0-9]+://)?[^/?#]*:([0-9]+)(?:[/?#]|$)", 1).try_cast("int")
    return F.coalesce(own, F.when(proxy_kind(url) == "socks5h", 1080).when(url.startswith("https://"), 443).otherwise(80))


def rescale(ticks: Column, numerator: int, denominator: int) -> Column:
    """Seconds of a time stamp in units of numerator / denominator seconds."""
    return ticks * (float(numerator) / denominator)


def decode_form(text: Column) -> Column:
    """Form decoding that takes every text: + is a space, and so is a percent sign with two characters that are no hexadecimal digits."""
    return F.try_url_decode(F.regexp_replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})..", "+"), "%(?![0-9A-Fa-f]{2})", "%25"))


def decode_login(text: Column) -> Column:
    """Percent decoding that keeps +."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def query_float(url: Column, name: str) -> Column:
    value = query_param(url, name)
    return F.when(value.rlike("^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"), value.try_cast("double"))


def detail_url(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{API_BASE}{kind}/"), key.cast("string"))


def episode_url(show: Column, season_: Column, episode_: Column) -> Column:
    return F.concat(detail_url("tv", show), F.lit("/season/"), season_.cast("string"), F.lit("/episode/"), episode_.cast("string"))


#: Subtitles that are pictures, and a library's artwork.
BITMAP_CODECS = ("hdmv_pgs_subtitle", "dvd_subtitle", "dvb_subtitle", "xsub")
ARTWORK = {"Movies": "/assets/movies.png", "Shows": "/assets/shows.png", "Other": "/assets/other.png"}


def artwork(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, v) for k, v in ARTWORK.items()])
