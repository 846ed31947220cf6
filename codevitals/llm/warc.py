"""WARC derivatives: metadata and plain-text conversion records of response records.

``responses`` makes response records of pages (ids from what they hold, so reruns agree); ``derivatives`` makes of each response one
``metadata`` record (JSON: the source's WARC and HTTP headers, these as a list because names repeat, title, meta tags and links resolved against its URI) and one ``conversion`` record (plain
text). Both refer to the response by WARC-Refers-To, keep its target URI, date and payload digest, and have their own ids and block digests;
``written`` gives a record's bytes as they stand in a file.

A null html is an empty payload and still gives both records; without a url the records have no target URI and links stay as
they are. Null and repeated page_ids are kept: equal rows give equal records. Other columns are not looked at. An empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import json
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATE = "1970-01-01T00:00:00Z"
_hides = re.compile(r"<!--|<(script|style|noscript|template)\b", re.I)
_closer = {name: re.compile(rf"</{name}\s*+>", re.I) for name in ("script", "style", "noscript", "template")}
_breaks = re.compile(
    r"</?(?:p|div|br|li|ul|ol|dl|dt|dd|h[1-6]|tr|table|section|article|header|footer|nav|aside|main|blockquote|pre|title|form|option|hr)\b[^<>]*>", re.I)
_tag = re.compile(r"<[/!?a-zA-Z][^<>]*>")
_blank = re.compile(r"[ \t\r\f\v\xa0]+")
_title, _title_end = re.compile(r"<title\b", re.I), re.compile(r"</title", re.I)
_linked = re.compile(r"<(a|area|link|img|script|iframe|form|source|embed)\b([^<>]*)>", re.I)
_meta = re.compile(r"<meta\b([^<>]*)>", re.I)
# A name is tried once, where it begins.
_attribute = re.compile(r"""(?<![-\w:.])([-\w:.]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'<>`]+))""")
_SCHEMA = ("page_id long, warc_type string, record_id string, refers_to string, target_uri string, date string, "
           "content_type string, content_length long, block_digest string, payload_digest string, block string")

_name = re.compile(r"[a-zA-Z_:].*", re.S)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(chr(0).join(parts).encode()).digest(), version=4)}>"


def shown(page: str, opening: bool = False) -> str:
    """The page with a space for each comment and each element that isn't shown, or with its opening tag if ``opening``.

    One scan forward: where nothing closes a comment or an element, it reaches to the end.
    """
    out, at, seen = [], 0, 0
    tags = True  # a tag can still end
    while m := _hides.search(page, seen):
        if m[1]:
            end = page.find(">", m.end()) + 1 if tags else 0
            if not end:
                tags, seen = False, m.end()
                continue
            mark = page[m.start():end] if opening else " "
            closer = _closer[m[1].lower()].search(page, end)
            seen = closer.end() if closer else len(page)
        else:
            mark, end = " ", page.find("-->", m.end())
            seen = end + 3 if end >= 0 else len(page)
        out += [page[at:m.start()], mark]
        at = seen
    return "".join([*out, page[at:]])


def title(page: str) -> str | None:
    m = _title.search(page)
    begin = page.find(">", m.end()) + 1 if m else 0
    end = _title_end.search(page, begin) if begin else None
    return entities.unescape(page[begin:end.start()]).strip() if end else None


def plain_text(page: str) -> str:
    text = _tag.sub("", _breaks.sub("\n", shown(page)))
    lines = (_blank.sub(" ", line).strip() for line in entities.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def attributes(tag: str) -> dict[str, str]:
    found = ((_name.search(m[1]), m[2] or m[3] or m[4] or "") for m in _attribute.finditer(tag))
    return {name[0].lower(): entities.unescape(value) for name, value in found if name}


def page_metadata(page: str, uri: str | None) -> dict:
    """Title, meta tags and links of a page."""
    page = shown(page, opening=True)
    links = []
    for m in _linked.finditer(page):
        found = attributes(m[2])
        for name in ("href", "src", "action"):
            if name in found:
                try:
                    target = urljoin(uri, found[name]) if uri else found[name]
                except ValueError:
                    target = found[name]
                links.append({"path": f"{m[1].upper()}@/{name}", "url": target} | ({"rel": found["rel"]} if "rel" in found else {}))
    return {"Head": {"Title": title(page),
                     "Metas": [attributes(m[1]) for m in _meta.finditer(page)]}, "Links": links}


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of ``pages`` (page_id, url, html): http (the HTTP header block) and payload apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(5)]
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = (page or "").encode()
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}\r\n\r\n"
                block, payload = digest(http.encode() + data), digest(data)
                for column, value in zip(rows, (record_id("response", url or "", block), date, http, block, payload), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), *(pa.array(c, pa.string()) for c in rows)],
                ["page_id", "target_uri", "payload", "record_id", "date", "http", "block_digest", "payload_digest"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(
        run, "page_id long, target_uri string, payload string, record_id string, date string, http string, block_digest string, payload_digest string")


def derived(response: dict) -> list[dict]:
    """The metadata and the conversion record of a response."""
    page, uri = response["payload"] or "", response["target_uri"]
    status, *headers = response["http"].rstrip("\r\n").split("\r\n")
    source = {"WARC-Type": "response", "WARC-Record-ID": response["record_id"], "WARC-Target-URI": uri, "WARC-Date": response["date"],
              "WARC-Block-Digest": response["block_digest"], "WARC-Payload-Digest": response["payload_digest"]}
    envelope = {"Envelope": {"WARC-Header-Metadata": {k: v for k, v in source.items() if v is not None}, "Payload-Metadata": {
        "HTTP-Response-Metadata": {"Status": status, "Headers": [h.split(": ", 1) for h in headers if ": " in h],
                                   "HTML-Metadata": page_metadata(page, uri)}}}}
    blocks = (("metadata", "application/json", json.dumps(envelope, ensure_ascii=False)), ("conversion", "text/plain", plain_text(page)))
    out = []
    for kind, content_type, block in blocks:
        data = block.encode(errors="replace")
        out.append({
            "page_id": response["page_id"], "warc_type": kind, "record_id": record_id(kind, response["record_id"]),
            "refers_to": response["record_id"], "target_uri": uri, "date": response["date"], "content_type": content_type,
            "content_length": len(data), "block_digest": digest(data), "payload_digest": response["payload_digest"], "block": data.decode()})
    return out


def written(record: dict) -> bytes:
    """A record's bytes in a file."""
    names = {"record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
             "block_digest": "WARC-Block-Digest", "payload_digest": "WARC-Source-Payload-Digest", "content_type": "Content-Type", "content_length": "Content-Length"}
    lines = ["WARC/1.1", f"WARC-Type: {record['warc_type']}", *(f"{n}: {record[k]}" for k, n in names.items() if record[k] is not None)]
    return "\r\n".join([*lines, "", record["block"], "", ""]).encode()


def read_records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """The headers and the block of each record of a file's bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        headers = [tuple(line.split(": ", 1)) for line in data[at:end].decode().split("\r\n")[1:]]
        size = int(next(v for k, v in headers if k == "Content-Length"))
        yield headers, data[end + 4:end + 4 + size]
        at = end + 8 + size


def derivatives(records: DataFrame) -> DataFrame:
    """The derived records of response ``records``."""
    names = ["page_id", "target_uri", "payload", "record_id", "date", "http", "block_digest", "payload_digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [d for r in batch.to_pylist() for d in derived(r)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in (x.split() for x in _SCHEMA.split(", "))])
    return records.select(names).mapInArrow(run, _SCHEMA)
