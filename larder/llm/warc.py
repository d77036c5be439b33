"""WARC derivatives: each response record gives a metadata and a plain-text conversion record.

Both refer to the response (WARC-Refers-To, its URI and date) and to each other; the metadata
record keeps all named fields of the source, WARC and HTTP, its digests and whether its payload
digest holds (both over the bytes as stored), and the page's title and links. The work is row by row, so
nothing is shuffled, and each step passes over a page once, however its tags are broken.

Before its text is read a payload's chunks are joined and gzip or deflate undone. Hidden parts of a page are
comments, scripts and styles (open ones to the end of the page), and closed noscript, template, svg and
title elements; of open ones only the tag goes, and head and body tags need not be there.

Defined results: a null or malformed record gives one row of type ``error`` with the reason and no
record; a record of another type gives nothing; a payload that is not text (by its type, or by null bytes where
it has none), is encoded otherwise, broken or larger than ``MOST_BYTES`` when undone, gives its metadata
record alone, with the reason in it and in ``reason``; an empty payload gives an empty text; a charset
that Python does not know is read as UTF-8, bytes that are no text as replacement characters;
repeated rows are converted one by one (into equal records); an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import table

#: Fixed values of the format.
VERSION = "WARC/1.1"
SOFTWARE = "larder"
#: The pages have no date of their own; the query's records bear this one.
DATE = "2024-01-01T00:00:00Z"
#: Rows handed back at once.
ROWS = 256

#: Bytes of a payload after its encodings are undone.
MOST_BYTES = 1 << 28

_OPEN = re.compile(r"<(?:(!--)|(script|style|noscript|template|svg|title)\b)", re.I)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template", "svg", "title")}
_CLOSE["!--"] = re.compile("-->")
_TO_THE_END = ("!--", "script", "style")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_ANCHOR = re.compile(r"<a\b([^>]*)>", re.I)
_HREF = re.compile(r"(?:^|\s)href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|"
                    r"h[1-6]|header|hr|li|main|nav|ol|option|p|pre|section|table|tbody|tfoot|thead|tr|ul)\b[^>]*>", re.I)
_CELL = re.compile(r"</?t[dh]\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^>]*>|<[!?][^>]*>")
_BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """The same record has the same id, whichever task makes it."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1('|'.join(parts).encode()).digest()[:16], version=5)}>"


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def response(key: str, url: str | None, page: str | None) -> bytes:
    """A response record around a page, as a crawler writes it."""
    payload = (page or "").encode()
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
             ).encode() + payload
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", key, url or "", digest(payload))),
              ("WARC-Date", DATE)] + ([("WARC-Target-URI", _field(url))] if url else [])
    return record(fields + [("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)),
                            ("Content-Type", "application/http; msgtype=response")], block)


def _field(value: str) -> str:
    return _BLANKS.sub(" ", value.replace("\n", " ")).strip()


def _fields(head: bytes) -> tuple[str, list[tuple[str, str]]]:
    """First line and named fields; a line that begins with a blank goes on with the field before."""
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return first, out


def _get(fields: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in fields if k.lower() == name.lower()), None)


def shown(page: str) -> str:
    """The page without its hidden parts. An element that is nowhere closed is looked for once."""
    out, at, never = [], 0, set()
    while found := _OPEN.search(page, at):
        name = (found[1] or found[2]).lower()
        out.append(page[at:found.start()])
        end = None if name in never else _CLOSE[name].search(page, found.end())
        tag = page.find(">", found.end())
        if name == "svg" and page[tag - 1:tag + 1] == "/>":
            at = tag + 1
        elif end:
            at = end.end()
        elif name in _TO_THE_END or tag < 0:
            return " ".join(out)
        else:
            never.add(name)
            at = tag + 1
    return " ".join([*out, page[at:]])


def tagged(page: str) -> tuple[str, str]:
    """The page up to its last ``>``, where every tag that begins ends, and the rest, which has no whole tag."""
    last = page.rfind(">") + 1
    return page[:last], page[last:]


def outlinks(page: str) -> list[str]:
    """Targets of the links of what is shown."""
    found = (_HREF.search(m[1]) for m in _ANCHOR.finditer(tagged(page)[0]))
    return [html.unescape(m[1] or m[2] or m[3] or "") for m in found if m]


def plain_text(page: str) -> str:
    """Lines of the visible text (``page``: what is shown): tags go, blocks break lines, blanks are joined."""
    page, rest = tagged(page)
    page = _TAG.sub("", _CELL.sub(" ", _BREAK.sub("\n", _BLANKS.sub(" ", page.replace("\n", " "))))) + _BLANKS.sub(" ", rest.replace("\n", " "))
    lines = (_BLANKS.sub(" ", line).strip() for line in html.unescape(page).split("\n"))
    return "\n".join(line for line in lines if line)


def _unchunked(data: bytes) -> bytes:
    out, at = [], 0
    while True:
        line, end = data.find(b"\r\n", at), 0
        size = int(data[at:line].split(b";")[0].strip(), 16) if line >= 0 else -1
        if size < 0:
            raise ValueError("broken chunks")
        if not size:
            return b"".join(out)
        end = line + 2 + size
        if end > len(data):
            raise ValueError("broken chunks")
        out.append(data[line + 2:end])
        at = end + 2


def _inflated(data: bytes, kinds: tuple[int, ...]) -> bytes:
    for bits in kinds:  # as the format says, else as some servers send it
        out, size, rest = [], 0, data
        try:
            while rest:  # gzip may have several members
                one = zlib.decompressobj(bits)
                out.append(one.decompress(rest, MOST_BYTES - size + 1))
                size += len(out[-1])
                if size > MOST_BYTES:
                    raise OverflowError("payload too large")
                if not one.eof:
                    raise ValueError("broken compression")
                rest = one.unused_data if bits > 16 else b""
            return b"".join(out)
        except zlib.error:
            continue
    raise ValueError("broken compression")


def undone(payload: bytes, sent: list[tuple[str, str]]) -> bytes:
    """The payload without its transfer and content encodings; ValueError or OverflowError says why it cannot be had."""
    names = [x.strip().lower() for field in ("Content-Encoding", "Transfer-Encoding") for x in (_get(sent, field) or "").split(",")]
    for name in reversed([n for n in names if n not in ("", "identity")]):
        if name == "chunked":
            payload = _unchunked(payload)
        elif name in ("gzip", "x-gzip"):
            payload = _inflated(payload, (16 + zlib.MAX_WBITS,))
        elif name == "deflate":
            payload = _inflated(payload, (zlib.MAX_WBITS, -zlib.MAX_WBITS))
        else:
            raise ValueError(f"encoding {_field(name)}")
    return payload


def is_text(kind: str | None, payload: bytes) -> bool:
    if kind is None:
        return b"\0" not in payload[:1024]
    main = kind.split(";")[0].strip().lower()
    return main.startswith("text/") or main.endswith(("+xml", "+json")) or main in (
        "", "application/xml", "application/json", "application/javascript", "application/xhtml")


def derive_one(raw: bytes | None) -> list[dict]:
    """The derivatives of one record, as rows of SCHEMA."""
    if raw is None:
        return [{"record_type": "error", "reason": "no record"}]
    head, gap, rest = raw.partition(b"\r\n\r\n")
    first, fields = _fields(head)
    source, length = _get(fields, "WARC-Record-ID"), _get(fields, "Content-Length")
    if not gap or not first.startswith("WARC/") or not source or not (length or "").isdigit():
        return [{"record_type": "error", "reason": "no WARC header"}]
    if (_get(fields, "WARC-Type") or "").lower() != "response":
        return []
    block = rest[:int(length)]
    if len(block) < int(length):
        return [{"record_type": "error", "reason": "block shorter than its length", "refers_to": source}]
    http, gap, payload = block.partition(b"\r\n\r\n")
    status, sent = _fields(http)
    if not gap or not status.startswith("HTTP/"):
        return [{"record_type": "error", "reason": "no HTTP header", "refers_to": source}]
    claimed, found = _get(fields, "WARC-Payload-Digest"), digest(payload)
    why = None
    try:
        body = undone(payload, sent)
        if not is_text(_get(sent, "Content-Type"), body):
            why, body = f"not text: {_field(_get(sent, 'Content-Type') or 'null bytes')}", b""
    except (ValueError, OverflowError) as problem:
        why, body = str(problem) if "int()" not in str(problem) else "broken chunks", b""
    kind = _get(sent, "Content-Type") or "text/html"
    charset = re.search(r"charset\s*=\s*[\"']?([^\s;\"']+)", kind, re.I)
    try:
        page = body.decode(charset[1] if charset else "utf-8", "replace")
    except (LookupError, ValueError):
        page = body.decode("utf-8", "replace")
    is_html = "html" in kind.lower()
    visible = shown(page) if is_html else page
    text = plain_text(visible) if is_html else page
    title = _TITLE.search(tagged(page)[0]) if is_html else None
    links = outlinks(visible) if is_html else []
    uri, date = _get(fields, "WARC-Target-URI"), _get(fields, "WARC-Date")
    ids = {t: record_id(t, source, claimed or found) for t in ("metadata", "conversion")}
    refers = [("WARC-Refers-To", source)] + ([("WARC-Refers-To-Target-URI", uri)] if uri else []) + (
        [("WARC-Refers-To-Date", date)] if date else [])
    # fields: what the page and its source say of themselves
    told = [("software", SOFTWARE), ("no-conversion", why) if why else ("conversion-record-id", ids["conversion"]),
            ("http-status", _field(status)), ("title", _field(html.unescape(title[1])) if title else ""), ("text-characters", str(len(text))),
            ("source-payload-digest", claimed or ""), ("computed-payload-digest", found),
            ("source-block-digest", _get(fields, "WARC-Block-Digest") or ""), ("computed-block-digest", digest(block))]
    told += [("warc-field", f"{k}: {v}") for k, v in fields] + [("http-field", f"{k}: {v}") for k, v in sent]
    told += [("outlink", _field(x)) for x in links]
    blocks = {"metadata": "".join(f"{k}: {v}\r\n" for k, v in told).encode(), "conversion": text.encode("utf-8", "replace")}
    kinds = {"metadata": "application/warc-fields", "conversion": "text/plain; charset=utf-8"}
    out = []
    for t, body in blocks.items():
        if why and t == "conversion":
            continue
        other = None if why else ids["conversion" if t == "metadata" else "metadata"]
        head_fields = [("WARC-Type", t), ("WARC-Record-ID", ids[t])] + ([("WARC-Date", date)] if date else []) + (
            [("WARC-Target-URI", uri)] if uri else []) + refers + (
            [("WARC-Concurrent-To", other)] if other else []) + [("WARC-Block-Digest", digest(body)), ("Content-Type", kinds[t])]
        out.append({"record_type": t, "record_id": ids[t], "refers_to": source, "concurrent_to": other, "target_uri": uri,
                    "date": date, "content_type": kinds[t], "block_digest": digest(body), "source_payload_digest": claimed,
                    "digest_ok": claimed is None or claimed == found, "n_links": len(links), "content_length": len(body),
                    "warc": record(head_fields, body), "reason": why})
    return out


SCHEMA = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("record_type", "record_id", "refers_to", "concurrent_to", "target_uri",
                                                 "date", "content_type", "block_digest", "source_payload_digest")),
    T.StructField("digest_ok", T.BooleanType()), T.StructField("n_links", T.LongType()),
    T.StructField("content_length", T.LongType()), T.StructField("warc", T.BinaryType()),
    T.StructField("reason", T.StringType())])


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id and ``record`` (binary): the pages as response records."""
    key = pages.schema[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                made = [response(*row) for row in zip(*(c.to_pylist() for c in b.columns[1:]))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=[id_col, "record"])

    return pages.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.col(url_col).alias(
            "url"), F.col(html_col).alias("html")).mapInArrow(
        run, T.StructType([key, T.StructField("record", T.BinaryType())]))


def derive(records: DataFrame, id_col: str, record_col: str = "record") -> DataFrame:
    """id and SCHEMA: the metadata and the conversion record of each response record."""
    schema = T.StructType([records.schema[id_col], *SCHEMA.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(SCHEMA)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                rows, source = [], []
                for k, raw in enumerate(b.column(1).to_pylist()):
                    got = derive_one(raw)
                    rows += got
                    source += [k] * len(got)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(source, pa.int64())),
                     *(pa.array([r.get(f.name) for r in rows], f.type) for f in kinds)], names=schema.names)

    return records.select(F.col(id_col).alias("id"), F.col(record_col).alias("record")).mapInArrow(run, schema)


def write(derived: DataFrame, path: str, compression: str = "gzip") -> None:
    """WARC files below ``path``, one a task: the records (which are all UTF-8) one after the other."""
    text = F.col("warc").cast("string")  # the last line end is the writer's
    derived.where("warc IS NOT NULL").select(F.substring(text, F.lit(1), F.char_length(text) - 2).alias("value")).write.option(
        "lineSep", "\r\n").option("compression", compression).text(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derive(responses(table(spark, sf_dir, "pages")), "page_id")
    return made.select("page_id", "record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "content_type",
                       "block_digest", "source_payload_digest", "digest_ok", "n_links", "content_length",
                       F.sha2("warc", 256).alias("warc_sha256"), "reason")
