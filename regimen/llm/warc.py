"""Operator 3: linked WARC metadata and conversion records derived from responses.

For every response record: a ``metadata`` record (title, language, links,
the source's HTTP status and headers) and a ``conversion`` record (plain text).
Both keep the response's id in WARC-Refers-To, its target URI, and carry the
digests of the source's payload and block beside their own block digest.
Everything is column expressions but for character references, which a small
pandas UDF resolves as HTML5 says; there is no shuffle.

Plain text: comments, scripts, styles, templates and the head are dropped, tags
that end a line become line ends, other tags vanish, named and numeric references
are resolved (a non-breaking space becomes a space), and white space is squeezed.  HTTP heads and warc-fields
have CRLF line ends.  Record ids are version-less UUID URNs of the MD5 of kind and source id, so that
a repeated run names the same records.

Defined cases: null HTML is an empty payload; a null URL gives no target URI
(null); a null page_id is the word ``null`` in the id; repeated rows give equal
records; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regimen.llm import common

# Elements without text of their own, and elements that end a line.
SILENT = ["script", "style", "noscript", "template", "head"]
LINES = ["p", "br", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "article", "section",
         "nav", "header", "footer", "blockquote", "pre"]
WHITE = "[ \\t\\r\\n\\f]"


def any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def drop_pattern() -> str:
    parts = ["<!--.*?-->"]
    parts += [f"<{any_case(e)}(?:{WHITE}[^>]*)?>.*?</{any_case(e)}{WHITE}*>" for e in SILENT]
    return "(?s)" + "|".join(parts)


def line_pattern() -> str:
    return f"</?(?:{'|'.join(any_case(e) for e in LINES)})(?:{WHITE}[^>]*|/)?>"


def resolve_references(texts):
    """Named and numeric character references of a pandas series of texts, as HTML5 resolves them."""
    from html import unescape

    return texts.map(lambda t: unescape(t) if t and "&" in t else t)


def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def swap(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {by})"


CRLF, LF = "concat(chr(13), chr(10))", "chr(10)"


def digest(x: str) -> str:
    return f"concat('sha256:', sha2({x}, 256))"


def urn(kind: str) -> str:
    """SQL: the URN of the record of that kind of a page."""
    name = f"md5(concat('{kind} ', coalesce(cast(page_id as string), 'null')))"
    return "concat('urn:uuid:', " + ", '-', ".join(f"substr({name}, {a}, {n})" for a, n in
                                                   ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + ")"


def plain_text(html: str) -> Column:
    """The text of a page's HTML (an SQL expression)."""
    bare = F.expr(swap(swap(swap(html, drop_pattern(), "''"), line_pattern(), LF), "<[^>]*>", "''"))
    resolved = F.pandas_udf(resolve_references, "string")(bare)
    # a carriage return or non-breaking space that a reference stands for is white space, too
    spaces = F.regexp_replace(F.translate(resolved, "\u00a0", " "), "[ \\t\\r\\f]+", " ")
    return F.trim(F.regexp_replace(spaces, " ?\\n[ \\n]*", "\n"), F.lit("\n "))


COLUMNS = ["page_id", "record_type", "record_id", "refers_to", "target_uri", "content_type", "content_length",
           "block_digest", "source_headers", "source_payload_digest", "source_block_digest", "block"]


def derive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Two records (COLUMNS) for every response."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("target_uri"), html.alias("html"))
    head = f"concat('Content-Type: text/html; charset=utf-8', {CRLF}, 'Content-Length: ', octet_length(html))"
    title = swap(f"regexp_extract(html, {quoted(f'(?s)<{any_case('title')}[^>]*>(.*?)</{any_case('title')}')}, 1)", WHITE + "+", "' '")
    lang = f"regexp_extract(html, {quoted(f'<{any_case('html')}[^>]*{WHITE}{any_case('lang')}=\"([^\"]*)\"')}, 1)"
    links = f"regexp_count(html, {quoted(f'<{any_case('a')}{WHITE}[^>]*{any_case('href')}=')})"
    rows = source.select("page_id", "target_uri", "html", F.expr(head).alias("source_headers"), F.expr(urn("response")).alias("refers_to"),
                         F.expr(digest("html")).alias("source_payload_digest"), plain_text("html").alias("plain"),
                         F.trim(F.expr(title)).alias("title"), F.expr(lang).alias("lang"), F.expr(links).alias("links"))
    response = F.expr(f"concat('HTTP/1.1 200 OK', {CRLF}, source_headers, {CRLF}, {CRLF}, html)")
    fields = F.expr(f"concat('title: ', title, {CRLF}, 'language: ', lang, {CRLF}, 'links: ', links, {CRLF}, 'source-status: 200', "
                    f"{CRLF}, 'source-', replace(source_headers, {CRLF}, concat({CRLF}, 'source-')), {CRLF})")

    def record(kind: str, content_type: str, block: Column) -> Column:
        return F.struct(F.lit(kind).alias("record_type"), F.expr(urn(kind)).alias("record_id"),
                        F.lit(content_type).alias("content_type"), block.alias("block"))

    pair = F.array(record("metadata", "application/warc-fields", fields),
                   record("conversion", "text/plain; charset=utf-8", F.col("plain")))
    rows = rows.withColumn("source_block_digest", F.sha2(response, 256)).withColumn(
        "source_block_digest", F.concat(F.lit("sha256:"), "source_block_digest")).withColumn("r", F.explode(pair))
    return rows.select("page_id", "r.record_type", "r.record_id", "refers_to", "target_uri", "r.content_type",
                       F.octet_length("r.block").cast("long").alias("content_length"),
                       F.expr(digest("r.block")).alias("block_digest"), "source_headers", "source_payload_digest",
                       "source_block_digest", "r.block").select(*COLUMNS)


def record_text(records: DataFrame, date: str | None = None) -> DataFrame:
    """One column ``record``: the records as WARC/1.1 text without their last line end.

    ``date`` (UTC, ``2026-01-31T00:00:00Z``) is every record's WARC-Date; by default the time of the call."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Refers-To", F.concat(F.lit("<"), "refers_to", F.lit(">"))), line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Block-Digest", F.col("block_digest")), line("WARC-Source-Payload-Digest", F.col("source_payload_digest")),
        line("WARC-Source-Block-Digest", F.col("source_block_digest")), line("Content-Type", F.col("content_type")),
        line("Content-Length", F.col("content_length").cast("string")))
    return records.select(F.concat(head, F.lit("\r\n"), F.col("block"), F.lit("\r\n")).alias("record"))


def write_records(records: DataFrame, path: str, date: str | None = None) -> None:
    """Write WARC files, one a partition."""
    record_text(records, date).write.option("lineSep", "\r\n").text(path)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived records of every page."""
    return derive(common.table(spark, sf_dir, "pages", "page_id", "url", "html"))


def reference_map() -> str:
    """DuckDB: a map of the HTML5 names that end with a semicolon, from Python's table."""
    from html.entities import html5

    names = sorted(n for n in html5 if n.endswith(";"))
    text = lambda x: "'" + x.replace("'", "''") + "'"
    return f"map([{', '.join(text(n) for n in names)}], [{', '.join(text(html5[n]) for n in names)}])"


# DuckDB's own way: references that end with a semicolon, cut out and looked up one by one.
ORACLE = f"""
with names as (select {reference_map()} as m),
p as (
  select page_id, url, coalesce(html, '') as html, chr(13) || chr(10) as nl,
    'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) as head,
    md5('response ' || coalesce(page_id::varchar, 'null')) as a, md5('metadata ' || coalesce(page_id::varchar, 'null')) as b,
    md5('conversion ' || coalesce(page_id::varchar, 'null')) as c
  from pages),
t as (
  select *, regexp_replace(regexp_replace(regexp_replace(html, '{drop_pattern()}', '', 'g'), '{line_pattern()}', chr(10), 'g'),
    '<[^>]*>', '', 'g') as bare,
    regexp_extract(html, '(?s)<{any_case("title")}[^>]*>(.*?)</{any_case("title")}', 1) as title,
    regexp_extract(html, '<{any_case("html")}[^>]*{WHITE}{any_case("lang")}="([^"]*)"', 1) as lang,
    len(regexp_extract_all(html, '<{any_case("a")}{WHITE}[^>]*{any_case("href")}=')) as links
  from p),
s as (select *, string_split_regex(bare, '&#?[0-9A-Za-z]+;') as parts, regexp_extract_all(bare, '&#?[0-9A-Za-z]+;') as refs from t),
u as (
  select s.* exclude (parts, refs), array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || case
    when i > len(refs) then ''
    when refs[i] like '&#x%' or refs[i] like '&#X%' then chr(('0x' || refs[i][4:-2])::int)
    when refs[i] like '&#%' then chr(refs[i][3:-2]::int)
    else coalesce(m[refs[i][2:]], refs[i]) end), '') as full_text
  from s, names),
v as (
  select *, trim(regexp_replace(regexp_replace(replace(full_text, chr(160), ' '), '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'),
    ' ' || chr(10)) as plain,
    'title: ' || trim(regexp_replace(title, '{WHITE}+', ' ', 'g')) || nl || 'language: ' || lang || nl || 'links: ' || links || nl
      || 'source-status: 200' || nl || 'source-' || replace(head, nl, nl || 'source-') || nl as fields
  from u),
r as (
  select *, unnest([{{'t': 'metadata', 'i': b, 'k': 'application/warc-fields', 'block': fields}},
    {{'t': 'conversion', 'i': c, 'k': 'text/plain; charset=utf-8', 'block': plain}}]) as x from v)
select page_id, x.t as record_type,
  'urn:uuid:' || x.i[1:8] || '-' || x.i[9:12] || '-' || x.i[13:16] || '-' || x.i[17:20] || '-' || x.i[21:] as record_id,
  'urn:uuid:' || a[1:8] || '-' || a[9:12] || '-' || a[13:16] || '-' || a[17:20] || '-' || a[21:] as refers_to,
  url as target_uri, x.k as content_type, strlen(x.block)::bigint as content_length, 'sha256:' || sha256(x.block) as block_digest,
  head as source_headers, 'sha256:' || sha256(html) as source_payload_digest,
  'sha256:' || sha256('HTTP/1.1 200 OK' || nl || head || nl || nl || html) as source_block_digest, x.block as block
from r
"""
