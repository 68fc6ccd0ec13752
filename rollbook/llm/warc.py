"""WARC derivatives: metadata and plain-text conversion records of responses.

A response record (target URI, date, HTTP header, HTML payload) yields one
``metadata`` record (source header, title, language, links, digests) and one
``conversion`` record (the page as plain text). Both name the response in
``WARC-Refers-To`` and carry their own block digest; ids are made from the
response's id, so a rerun makes the same records.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIDDEN = regex.compile(r"<!--.*?-->|<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>|<!--.*|<(script|style|noscript|template)\b.*", regex.S | regex.I)
# Elements that begin a new line of text.
BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
NAME = regex.compile(r"/?[a-zA-Z][a-zA-Z0-9]*")
LANG = regex.compile(r"\blang\s*=\s*[\"']?([\w-]+)", regex.I)
HREF = regex.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", regex.I)

SCHEMA = """warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string,
content_length long, block_digest string, source_payload_digest string, source_block_digest string, header string, block string"""


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def one_line(text: str) -> str:
    return " ".join(text.split())


def pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """A page's parts in one pass: a tag's name (with ``/`` for an end tag; empty for other markup), its inside, and the text that follows it.

    The text before the first tag comes under an empty name. A ``<`` that no
    ``>`` follows is text, and so is one that begins no tag.
    """
    name, inside, begin, at = "", "", 0, page.find("<")
    while at >= 0:
        if page[at + 1 : at + 2].isascii() and (page[at + 1 : at + 2].isalpha() or page[at + 1 : at + 2] in ("/", "!", "?")):
            end = page.find(">", at)
            if end < 0:
                break
            yield name, inside, page[begin:at]
            found = NAME.match(page, at + 1, end)
            name, inside, begin = found[0].lower() if found else "", page[at + 1 : end], end + 1
            at = page.find("<", begin)
        else:
            at = page.find("<", at + 1)
    yield name, inside, page[begin:]


def plain_text(page: str) -> str:
    """Text of a page: hidden elements gone, a line for each block element, entities decoded, white space runs as one space."""
    bare = "".join(["\n" * (name.removeprefix("/") in BLOCK) + text for name, _, text in pieces(HIDDEN.sub(" ", page))])
    lines = (one_line(line) for line in entities.unescape(bare).split("\n"))
    return "\n".join(line for line in lines if line)


def metadata_fields(uri: str, http_header: str, page: str) -> list[tuple[str, str]]:
    """Fields of the metadata record: the source's header lines, then what the page says of itself."""
    title, parts, language, hrefs = "", None, "", []
    for name, inside, text in pieces(HIDDEN.sub(" ", page)):
        if name == "title" and not title and parts is None:
            parts = []
        elif name == "/title" and parts is not None:
            title, parts = title or one_line(entities.unescape("".join(parts))), None
        if parts is not None:
            parts.append(text)
        if name == "html" and not language and (m := LANG.search(inside)):
            language = m[1]
        elif name == "a" and (m := HREF.search(inside)):
            hrefs.append(one_line(entities.unescape(next((x for x in m.groups() if x), ""))))
    out = [("source-" + name.strip().lower(), one_line(value)) for name, colon, value in (line.partition(":") for line in http_header.splitlines()[1:]) if colon]
    if title:
        out.append(("title", title))
    if language:
        out.append(("language", language))
    for href in dict.fromkeys(hrefs):
        if href:
            try:
                out.append(("outlink", urljoin(uri, href)))
            except ValueError:
                out.append(("outlink", href))
    return out


def derive(response_id: str, uri: str, date: str, http_header: str, page: str) -> list[tuple]:
    """The metadata and the conversion record of one response."""
    payload = page.encode("utf-8", "replace")
    source = http_header.encode("utf-8", "replace") + payload
    payload_digest, source_digest = digest(payload), digest(source)
    fields = [*metadata_fields(uri, http_header, page), ("source-payload-digest", payload_digest), ("source-block-digest", source_digest), ("source-length", str(len(source)))]
    made = (
        ("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields)),
        ("conversion", "text/plain; charset=utf-8", plain_text(page)),
    )
    out = []
    for kind, content, block in made:
        data = block.encode("utf-8", "replace")
        own, own_digest = record_id(response_id, kind), digest(data)
        lines = [
            ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", response_id), ("WARC-Target-URI", uri), ("WARC-Date", date),
            ("WARC-Block-Digest", own_digest), ("Content-Type", content), ("Content-Length", str(len(data))),
        ]
        header = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines if v) + "\r\n"
        out.append((kind, own, response_id, uri, date, content, len(data), own_digest, payload_digest, source_digest, header, block))
    return out


def responses(pages: DataFrame, *, date: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of a table of pages, their ids made from page id and URL. Null URLs and pages count as empty."""
    page = F.coalesce(html_col, F.lit(""))
    header = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(page).cast("string"), F.lit("\r\n\r\n"))
    h = F.md5(F.concat_ws("\n", F.coalesce(F.col(id_col).cast("string"), F.lit("")), url_col))
    parts = [F.substr(h, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return pages.select(
        F.col(id_col).alias("id"), F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("response_id"),
        F.coalesce(url_col, F.lit("")).alias("uri"), F.lit(date).alias("date"), header.alias("http_header"), page.alias("page"),
    )


def derivatives(found: DataFrame) -> DataFrame:
    """Two records for each response (``id, response_id, uri, date, http_header, page``), in its own task.

    An empty page gives an empty conversion and a metadata record of its
    source alone. Repeated responses give repeated records with the same ids.
    """
    names = [c.split()[0] for c in SCHEMA.replace("\n", " ").split(",")]
    id_type = found.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                part = whole.iloc[at : at + 500]
                rows = [derive(*r) for r in part[["response_id", "uri", "date", "http_header", "page"]].itertuples(index=False, name=None)]
                out = pd.DataFrame([x for two in rows for x in two], columns=names)
                out.insert(0, "id", part["id"].repeat(2).to_numpy())
                yield out

    return found.mapInPandas(run, f"id {id_type}, {SCHEMA}")
