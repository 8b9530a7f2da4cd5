"""WARC derivatives: metadata and plain-text conversion records linked to responses; Spark functions only, no shuffle.

responses() writes pages as WARC/1.1 response records; parsed() reads records of any origin into header fields (in
order, repeated ones too), HTTP header fields and payload; derivatives() makes of each response
  - a `metadata` record (application/warc-fields) with the source's HTTP status, all its HTTP headers and its other WARC headers, and
  - a `conversion` record (text/plain) with the text of an HTML payload, or any other text payload as it is,
both with WARC-Refers-To and the source's target URI, date and payload digest, and digests of their own blocks.
Record ids are name-based: the same input gives the same ids.

Defined results: a null URL or page counts as empty (the record stays); a payload that is no text or has none converts to an
empty block; a source without a payload digest gets one computed; a Content-Length that is no number, or below 0, is not obeyed; repeated rows give repeated records; a record that is not a response has no derivatives, nor has one whose lines do not end in CRLF, since it has no type; an empty table gives an empty result;
other columns of the input are dropped, so they may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
#: Patterns applied in this order; all but BLANKS in the common subset of Java's and RE2's syntax.
HIDDEN = r"(?is)<(?:!--.*?-->|script\b.*?</script\s*>|style\b.*?</style\s*>|head\b.*?</head\s*>)"
BREAKS = r"(?i)</?(?:p|div|br|h[1-6]|li|ul|ol|tr|table|article|section|nav|header|footer|blockquote|pre|hr)\b[^>]*>"
TAGS = r"(?s)<[^>]*>"
#: Runs of blanks that are not one space already.
BLANKS = r"[ \t\r\f\x0b](?:[ \t\r\f\x0b]+|(?<! ))"
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"), ("&lsquo;", "‘"), ("&rsquo;", "’"),
    ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"), ("&bull;", "•"), ("&middot;", "·"), ("&euro;", "€"), ("&pound;", "£"), ("&cent;", "¢"), ("&deg;", "°"), ("&times;", "×"), ("&agrave;", "à"), ("&aacute;", "á"),
    ("&acirc;", "â"), ("&auml;", "ä"), ("&aring;", "å"), ("&ccedil;", "ç"), ("&egrave;", "è"), ("&eacute;", "é"), ("&ecirc;", "ê"), ("&euml;", "ë"), ("&iacute;", "í"), ("&ntilde;", "ñ"), ("&oacute;", "ó"), ("&ocirc;", "ô"),
    ("&ouml;", "ö"), ("&uacute;", "ú"), ("&uuml;", "ü"), ("&szlig;", "ß"), ("&amp;", "&"),
)


def once(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unescaped(text: Column) -> Column:
    """Entities as characters, by number or by one of the common names, in one pass: what an entity gives is not read again; others stay as they are."""
    parts = F.split(text, "&")
    names = F.create_map(*[F.lit(x) for entity, char in ENTITIES for x in (entity[1:-1], char)])

    def one(part: Column) -> Column:
        end = F.instr(part, ";")
        name = F.substring(part, 1, 10)
        name = F.when(end.between(2, 11), F.substring_index(name, ";", 1))
        char = F.when(F.startswith(name, F.lit("#")), numbered(name)).otherwise(F.try_element_at(names, name))
        return F.coalesce(F.concat(char, part.substr(end + 1, F.length(part))), F.concat(F.lit("&"), part))

    first = lambda x: F.get(x, F.lit(0))
    # the text is named once here: what makes it is computed again for each place that names it
    return once(parts, lambda x: F.when(F.size(x) > 1, F.concat(first(x), F.array_join(F.transform(F.slice(x, F.lit(2), F.size(x)), one), ""))).otherwise(first(x)))


def numbered(name: Column) -> Column:
    """The character of #123 or #x7B; null if there is none."""
    number = F.when(F.rlike(name, F.lit("^#[xX][0-9a-fA-F]{1,6}$")), F.conv(F.substring(name, 3, 6), 16, 10)).when(F.rlike(name, F.lit("^#[0-9]{1,7}$")), F.substring(name, 2, 7)).cast("int")
    return F.when(number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))


def plain_text(html: Column) -> Column:
    """Visible text of an HTML page, one line for each block."""
    text = F.regexp_replace(html, HIDDEN, " ")
    text = F.regexp_replace(text, BREAKS, "\n")
    text = F.regexp_replace(text, TAGS, "")
    text = unescaped(text)
    text = F.regexp_replace(text, BLANKS, " ")
    lines = F.transform(F.split(text, "\n"), lambda line: F.trim(line))
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


#: Headers of the source that the derivatives' own headers carry, or that follow from the block.
CARRIED = ("warc-type", "warc-record-id", "warc-target-uri", "warc-date", "warc-payload-digest", "content-type", "content-length")


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def record_id(*name: Column) -> Column:
    """<urn:uuid:...> from the hash of a name."""
    h = F.md5(F.concat_ws("|", *name))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.concat(F.lit(k + ": "), v, F.lit(CRLF)) for k, v in headers]
    return F.concat(F.lit("WARC/1.1" + CRLF), *lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block, F.lit(CRLF + CRLF))


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """source_id and record (a WARC response record) of every page."""
    base = pages.select(pages[id_col].alias("source_id"), F.coalesce(pages[url_col], F.lit("")).alias("uri"), F.coalesce(pages[html_col], F.lit("")).alias("html"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("html").cast("string"), F.lit(CRLF + CRLF))
    base = base.withColumn("block", F.concat(head, "html")).withColumn("payload_digest", digest(F.col("html")))
    headers = [
        ("WARC-Type", F.lit("response")),
        ("WARC-Record-ID", record_id(F.lit("response"), F.coalesce(F.col("source_id").cast("string"), F.lit("")), F.col("uri"), F.col("payload_digest"))),
        ("WARC-Target-URI", F.col("uri")),
        ("WARC-Date", F.lit(date)),
        ("WARC-Payload-Digest", F.col("payload_digest")),
        ("WARC-Block-Digest", digest(F.col("block"))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
    ]
    return base.select("source_id", _record(headers, F.col("block")).alias("record"))


def _fields(head: Column) -> Column:
    """Header lines as an array of (k, v) in their order, repeats too; names in lower case. A line that starts with a blank goes on with the one before."""
    unfolded = F.regexp_replace(head, r"\r\n[ \t]+", " ")
    lines = F.filter(F.split(unfolded, CRLF), lambda l: F.instr(l, ":") > 1)
    return F.transform(lines, lambda l: F.struct(F.lower(F.trim(F.substring_index(l, ":", 1))).alias("k"), F.trim(l.substr(F.instr(l, ":") + 1, F.length(l))).alias("v")))


def value_of(fields: Column, name: str) -> Column:
    """The first value of a header; empty if there is none."""
    return F.coalesce(F.get(F.filter(fields, lambda f: f["k"] == name), F.lit(0))["v"], F.lit(""))


def _listed(fields: Column, prefix: str) -> Column:
    """Header lines written again, each name behind a prefix, in their order."""
    return F.array_join(F.transform(fields, lambda f: F.concat(F.lit(prefix), f["k"], F.lit(": "), f["v"], F.lit(CRLF))), "")


def _behind(text: Column, head: Column, gap: str) -> Column:
    """The bytes of a text behind its head and the gap that ends it; none if the text is all head."""
    return text.cast("binary").substr(F.octet_length(head) + len(gap) + 1, F.octet_length(text))


def parsed(records: DataFrame, record_col: str = "record") -> DataFrame:
    """records with warc (header fields), status_line, http (header fields) and payload in place of the record.

    The block is as long as Content-Length says, in bytes; without one it ends with the record.
    """
    gap = CRLF + CRLF
    # cuts go by bytes: places in a text would be counted from its start each time
    rec, block = F.col(record_col), F.col("_block")
    df = records.withColumn("_head", F.substring_index(rec, gap, 1)).withColumn("warc", _fields(F.col("_head")))
    size = F.expr("try_cast(get(filter(warc, f -> f.k = 'content-length'), 0).v as int)")
    df = df.withColumn("_rest", _behind(rec, F.col("_head"), gap)).withColumn("_size", F.when(size >= 0, size))
    whole = F.octet_length("_rest") - F.when(F.col("_rest").cast("string").endswith(gap), 4).otherwise(0)
    begin = lambda n: F.col("_rest").substr(F.lit(1), n).cast("string")
    # a cut inside a character drops its start, 3 bytes at most
    cut = F.coalesce(*[F.try_validate_utf8(begin(F.greatest(F.col("_size") - k, F.lit(0)))) for k in range(4)], begin(F.col("_size")))
    df = df.withColumn("_block", F.when(F.col("_size").isNull() | (F.col("_size") == whole), begin(whole)).otherwise(cut))
    answer = F.startswith(block, F.lit("HTTP/"))
    df = df.withColumn("_http", F.when(answer, F.substring_index(block, gap, 1)).otherwise(""))
    http, payload = F.col("_http"), F.when(answer, _behind(block, F.col("_http"), gap).cast("string")).otherwise(block)
    df = df.withColumn("status_line", F.substring_index(http, CRLF, 1)).withColumn("http", _fields(http)).withColumn("payload", payload)
    return df.drop("_head", "_rest", "_size", "_block", "_http", record_col)


def derivatives(records: DataFrame, record_col: str = "record") -> DataFrame:
    """Two rows for each response: source_id, record_type, record_id, refers_to, target_uri, date, source_payload_digest, block_digest, block and record."""
    df = parsed(records.select("source_id", record_col), record_col)
    # a generator of one row: what stands above reads the parsed columns and does not compute them again
    df = df.select("source_id", F.inline(F.array(F.struct("warc", "status_line", "http", "payload")))).where(F.lower(value_of(F.col("warc"), "warc-type")) == "response")
    of = lambda name: value_of(F.col("warc"), name)
    # what the derivatives' own headers say of the source is not said twice
    others = F.filter("warc", lambda f: ~f["k"].isin(*CARRIED))
    fields = F.concat(F.lit("http-status: "), F.col("status_line"), F.lit(CRLF), _listed(F.col("http"), "http-"), _listed(others, "source-"))
    kind = F.lower(value_of(F.col("http"), "content-type"))
    text = F.when(F.contains(kind, F.lit("html")), plain_text(F.col("payload"))).when(F.startswith(kind, F.lit("text/")), F.col("payload")).otherwise(F.lit(""))
    known = of("warc-payload-digest")
    payload_digest = F.when(known != "", known).otherwise(digest(F.col("payload")))
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), text.alias("block")),
    )
    df = df.select("source_id", of("warc-record-id").alias("refers_to"), of("warc-target-uri").alias("target_uri"), of("warc-date").alias("date"), payload_digest.alias("source_payload_digest"), F.explode(kinds).alias("k"))
    df = df.select("source_id", "refers_to", "target_uri", "date", "source_payload_digest", "k.record_type", "k.content_type", "k.block")
    df = df.withColumn("record_id", record_id(F.col("record_type"), F.col("refers_to"))).withColumn("block_digest", digest(F.col("block")))
    headers = [
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", F.col("record_id")),
        ("WARC-Refers-To", F.col("refers_to")),
        ("WARC-Refers-To-Target-URI", F.col("target_uri")),
        ("WARC-Refers-To-Date", F.col("date")),
        ("WARC-Target-URI", F.col("target_uri")),
        ("WARC-Date", F.col("date")),
        ("X-Source-Payload-Digest", F.col("source_payload_digest")),
        ("WARC-Block-Digest", F.col("block_digest")),
        ("Content-Type", F.col("content_type")),
    ]
    return df.withColumn("record", _record(headers, F.col("block"))).drop("content_type")
