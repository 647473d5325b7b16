"""WARC derivatives: metadata and plain-text conversion records of response records.

``responses`` makes response records of pages, or ``read_warc`` reads them from
files. ``derivatives`` gives each response two linked records:

- ``metadata`` (application/warc-fields) with what the page says about itself and
  the source's own headers, each prefixed by ``source-``;
- ``conversion`` (text/plain) with the page's text.

Both refer to the response (WARC-Refers-To, its target URI and date), carry its
payload digest, and name each other (WARC-Concurrent-To). Identifiers are made of
id, address, date and payload, so a run repeated gives the same records, and records that
differ have different ones. ``serialized`` gives a record's bytes and ``write_warc``
writes files that ``read_warc`` reads back.

Blocks are bytes. A page is decoded by the charset of its HTTP header, or else its
own, or else as UTF-8; bytes that it does not have become U+FFFD. Files are read as a
stream of pieces between version lines, put together by Content-Length, so an
archive of any size needs room for one record only.

Everything is a narrow map over the responses: no shuffle.

Defined cases: a null page is an empty payload; a null address an empty one;
pages equal in id, address and payload have equal records, each page its own; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossgrain.llm.common import keyed, read_table

#: Namespace of record identifiers.
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:crossgrain:warc")
RECORD = "record_id string, warc_type string, target_uri string, warc_date string, refers_to string, concurrent_to string, headers array<struct<name:string,value:string>>, content_type string, block_digest string, payload_digest string, block binary"
_NAMES = [f.split()[0] for f in RECORD.split(", ")]
_HEADERS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))

#: Elements whose content is no text, and elements that end a line; fixed values.
HIDDEN = ("script", "style", "noscript", "template")
BLOCKS = frozenset("address article aside blockquote br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table td th title tr ul".split())
_COMMENT = r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
#: The rest of a tag: attributes, in whose quotes a tag's end may stand. A ``<`` outside of quotes ends no tag: it begins one, or is text.
_REST = r"(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>"
_ANY_REST = rf"(?:{_REST}|[^<>]*>)"
_TITLED = rf"<title(?=[\s/>]){_ANY_REST}(?:(?:(?!</head\b|<body\b|<title\b).)*?</title\s*>|[^<]*)"
_DARK = rf"<(?P<NAME>{'|'.join(HIDDEN)})\b{_ANY_REST}.*?(?:</(?P=NAME)\s*>|\Z)"
#: A head ends with its tag, or before the first text or element that cannot be in one: its end tag may be left out.
_HEAD = rf"<head(?=[\s/>]){_ANY_REST}(?:\s+|{_COMMENT}|{_TITLED}|{_DARK.replace('NAME', 'inner')}|</?(?:meta|link|base|basefont|bgsound|noframes|title|{'|'.join(HIDDEN)})(?=[\s/>]){_ANY_REST})*+(?:</head\s*>)?"
_PART = re.compile(rf"{_COMMENT}|(?P<head>{_HEAD})|{_DARK.replace('NAME', 'hidden')}|</?(?P<tag>[a-zA-Z][a-zA-Z0-9]*){_ANY_REST}", re.DOTALL | re.IGNORECASE)
_UNSAID = re.compile(rf"{_COMMENT}|{_DARK.replace('NAME', 'hidden')}", re.DOTALL | re.IGNORECASE)
_SPACE = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[\s]*")
#: A tag, its attributes as one text; what is no whole tag is none, as in ``plain_text``.
_TAG = re.compile(rf"<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9]*)(?P<rest>{_ANY_REST})", re.DOTALL)
_TITLE_END = re.compile(r"</title\s*>", re.IGNORECASE)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.IGNORECASE)
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", re.IGNORECASE)


def digest(data: bytes) -> str:
    """A labelled SHA-1 in base 32, as WARC files carry it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def identifier(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(31).join(parts))}>"


def plain_text(page: str) -> str:
    """The page's text: no markup, hidden parts or comments; a line for each block, single spaces."""

    def gap(m: re.Match[str]) -> str:
        return "\n" if (m["tag"] or "").lower() in BLOCKS else " " if m["head"] or m["hidden"] else ""

    text = html.unescape(_PART.sub(gap, page.replace("\n", " ")))
    return _LINES.sub("\n", _SPACE.sub(" ", text)).strip()


def decoded(payload: bytes, head: str = "") -> str:
    """The page in a payload, by the charset of its header ``head``, its own among its first 1,024 bytes, or UTF-8."""
    said = _CHARSET.search(head) or _CHARSET.search(payload[:1024].decode("latin-1"))
    try:
        return payload.decode(said[1] if said else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def one_line(text: str) -> str:
    return " ".join(text.split())


def about(page: str) -> list[tuple[str, str]]:
    """What a page says of itself: title, language, charset and its links, in order; comments and scripts say nothing.

    One pass over the tags; only what stands inside a tag is searched for attributes.
    """
    page = _UNSAID.sub("", page)
    title = lang = None
    titled = True  # a title may still be found: its end tag stands somewhere ahead
    links = []
    for m in _TAG.finditer(page):
        tag = m["tag"].lower()
        if m["end"]:
            continue
        if tag == "a" and (href := _HREF.search(m["rest"])):
            links.append(one_line(html.unescape(href[1] or href[2] or href[3] or "")))
        elif tag == "html" and lang is None:
            lang = _LANG.search(m["rest"])
        elif tag == "title" and title is None and titled:
            end = _TITLE_END.search(page, m.end())
            titled = end is not None
            title = page[m.end() : end.start()] if end else None
    charset = _CHARSET.search(page)
    out = [("title", one_line(html.unescape(title)))] if title is not None else []
    out += [("lang", lang[1])] if lang else []
    out += [("charset", charset[1])] if charset else []
    return out + [("outlink", link) for link in links]


def responses(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records (id, then RECORD's columns) of pages; the block is the HTTP message."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("key"), text(url_col).alias("url"), text(html_col).alias("html"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, url, page in zip(*(c.to_pylist() for c in batch.columns)):
                body = page.encode()
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
                rows.append((identifier("response", str(key), url, date, digest(body)), "response", one_line(url), date, None, None, [], "application/http; msgtype=response", digest(http.encode() + body), digest(body), http.encode() + body))
            yield _batch(batch.column(0), rows)

    return rows.mapInArrow(run, keyed("key", rows.schema[0].dataType, RECORD))


def _batch(key: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(_NAMES)
    return pa.record_batch([key, *(pa.array([[{"name": a, "value": b} for a, b in h] for h in c], _HEADERS) if n == "headers" else pa.array(c, pa.binary() if n == "block" else pa.string()) for n, c in zip(_NAMES, cols))], names=["key", *_NAMES])


def derivatives(records: DataFrame) -> DataFrame:
    """For every response of ``records`` (key and RECORD's columns) its metadata and conversion records."""
    rows = records.where("warc_type = 'response'").select("key", "record_id", "target_uri", "warc_date", "payload_digest", F.coalesce("block", F.lit(b"")).alias("block"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                own, out = batch.slice(at, 500), []
                for source, url, date, payload_digest, block in zip(*(c.to_pylist() for c in own.columns[1:])):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    status, *lines = head.decode("latin-1").split("\r\n")
                    page = decoded(payload, next((x for x in lines if x.lower().startswith("content-type:")), ""))
                    sources = [("source-status", status), *((f"source-{a.strip().lower()}", one_line(b)) for a, _, b in (x.partition(":") for x in lines))]
                    payload_digest = payload_digest or digest(payload)
                    fields = [*about(page), *sources, ("source-payload-digest", payload_digest)]
                    ids = {kind: identifier(kind, source or "", url or "", date or "", payload_digest) for kind in ("metadata", "conversion")}
                    blocks = {"metadata": ("application/warc-fields", "".join(f"{a}: {b}\r\n" for a, b in fields)), "conversion": ("text/plain; charset=utf-8", plain_text(page))}
                    refers = [("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", date), ("WARC-Source-Payload-Digest", payload_digest)]
                    for kind, other in (("metadata", "conversion"), ("conversion", "metadata")):
                        content, text = blocks[kind]
                        data = text.encode("utf-8", "replace")
                        d = digest(data)
                        out.append((ids[kind], kind, url, date, source, ids[other], refers + (sources if kind == "conversion" else []), content, d, d, data))
                twice = pa.array([i for i in range(own.num_rows) for _ in range(2)], pa.int64())
                yield _batch(own.column(0).take(twice), out)

    return rows.mapInArrow(run, keyed("key", records.schema["key"].dataType, RECORD))


def serialized(records: DataFrame) -> DataFrame:
    """(key, record): a record's header and block as bytes, without the two line ends that close it."""
    field = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c, F.lit("\r\n"))).otherwise("")
    own = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"], F.lit("\r\n"))), "")
    names = {"WARC-Type": "warc_type", "WARC-Record-ID": "record_id", "WARC-Date": "warc_date", "WARC-Target-URI": "target_uri", "WARC-Refers-To": "refers_to", "WARC-Concurrent-To": "concurrent_to", "WARC-Block-Digest": "block_digest", "WARC-Payload-Digest": "payload_digest", "Content-Type": "content_type"}
    size = F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string"), F.lit("\r\n\r\n"))
    head = F.concat(F.lit(VERSION + "\r\n"), *[field(k, F.col(v)) for k, v in names.items()], own, size)
    return records.select("key", F.concat(head.cast("binary"), F.col("block")).alias("record"))


VERSION = "WARC/1.1"
#: What files are cut at to be read as a stream.
_CUT = "WARC/1."


def write_warc(records: DataFrame, path: str) -> None:
    """Writes the records to gzip-compressed WARC files, one for each task; a file is one gzip member."""
    serialized(records).select(F.col("record").cast("string").alias("record")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def _fields(head: bytes) -> tuple[dict, int]:
    """A record's known fields, the others under ``headers``, and the length of its block."""
    known = {"warc-type": "warc_type", "warc-record-id": "record_id", "warc-date": "warc_date", "warc-target-uri": "target_uri", "warc-refers-to": "refers_to", "warc-concurrent-to": "concurrent_to", "warc-block-digest": "block_digest", "warc-payload-digest": "payload_digest", "content-type": "content_type"}
    out, size = {"headers": []}, 0
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        value = value.strip()
        if name.lower() == "content-length":
            size = int(value)
        elif name.lower() in known:
            out[known[name.lower()]] = value
        elif name:
            out["headers"].append((name, value))
    return out, size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(key, RECORD's columns) of the records in WARC files, gzip-compressed or not; the key is the record's id.

    Spark's text reader streams the files, cut at the version line. A block may hold such a line itself: pieces are joined until
    the block has its length. What a file lacks at its end is an error. A gzip file is read by one task from end to end. Any other
    is read in splits, which know no records: its pieces are sent to one task, in order, which streams them too.
    """
    text = spark.read.option("lineSep", _CUT).text(path)
    text = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("piece"))
    zipped = F.lower("file").endswith(".gz")
    split = text.where(~zipped).withColumn("place", F.monotonically_increasing_id()).repartition("file").sortWithinPartitions("file", "start", "place")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        of, have, need, fields = None, 0, None, {}
        out: list[tuple] = []

        def whole() -> None:
            nonlocal held, have, need
            data = b"".join(held)
            at = data.index(b"\r\n\r\n") + 4
            block = data[at : at + need]
            out.append(tuple({**fields, "block": block}.get(n) for n in _NAMES))
            held, have, need = [], 0, None

        for batch in batches:
            for file, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and file != of:
                    raise ValueError(f"{of} ends within a record")
                of = file
                if held:
                    piece = _CUT.encode() + piece
                elif not piece.strip():
                    continue  # before the first record
                held.append(piece)
                have += len(piece)
                if need is None and b"\r\n\r\n" in (data := b"".join(held)):
                    held, end = [data], data.index(b"\r\n\r\n")
                    fields, need = _fields(data[:end])
                    start = end + 4
                if need is not None and have >= start + need:
                    whole()
            if out:
                yield _batch(pa.array([r[0] for r in out], pa.string()), out)
                out = []
        if held:
            raise ValueError(f"{of} ends within a record")

    columns = ["file", "piece"]
    return text.where(zipped).select(columns).mapInArrow(run, f"key string, {RECORD}").unionByName(split.select(columns).mapInArrow(run, f"key string, {RECORD}"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page its metadata and conversion records: page_id, record_id, warc_type, ..., block as text."""
    found = derivatives(responses(read_table(spark, sf_dir, "pages"))).withColumnRenamed("key", "page_id")
    return found.withColumn("block", F.col("block").cast("string"))
