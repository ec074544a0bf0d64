"""WARC records: responses from pages, derived metadata and plain-text conversion records, files of records."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duebook.llm.common import file_system, ship, slices
from duebook.session import materialise

RECORD = "record_id string, type string, refers_to string, uri string, date string, headers map<string,string>, block binary"
#: Name space of record identifiers: the identifier of a record follows from what it holds, so a task that runs again makes the same ones.
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:duebook:warc")

_TOKENS = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
                     re.S | re.I)
_BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
                   "li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_BLANKS = re.compile(r"[^\S\n]{2,}|[^\S\n ]")
_ORIGIN = re.compile(r"https?://[^/?#]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(0).join(map(str, parts)))}>"


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in order, and payload of an HTTP response; a block without an empty line is all payload."""
    at = re.search(rb"\r?\n\r?\n", block)
    if not block.startswith(b"HTTP/") or not at:
        return "", [], block
    lines = block[:at.start()].decode("utf-8", "replace").splitlines()
    pairs = [tuple(x.strip() for x in line.split(":", 1)) for line in lines[1:] if ":" in line]
    return lines[0], pairs, block[at.end():]


def _absolute(base: str, target: str) -> str:
    """The target seen from its base; a path from the root needs no parsing, a malformed one stays as it is."""
    if target.startswith("/") and not target.startswith("//") and "/." not in target and (origin := _ORIGIN.match(base)):
        return origin[0] + target
    try:
        return urljoin(base, target)
    except ValueError:
        return target


def extract(page: str, uri: str = "") -> dict:
    """Title, language, links, meta tags and text of a page.

    Scripts, styles and comments are left out; block elements end a line; blanks run together; entities are resolved.
    """
    out, links, metas, title, lang, at, base = [], [], [], None, None, 0, uri
    in_title = None
    for m in _TOKENS.finditer(page):
        if m.start() > at:
            out.append(page[at:m.start()].replace("\n", " "))
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name in _BLOCK:
            out.append("\n")
        if name == "title":
            if not m[2] and title is None:
                in_title = len(out)
            elif m[2] and in_title is not None:
                title, in_title = _BLANKS.sub(" ", html.unescape("".join(out[in_title:]))).strip(), None
        if not m[2] and name in ("a", "link", "img", "meta", "html", "base", "area", "iframe"):
            got = {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in _ATTRIBUTE.finditer(m[4])}
            if name == "html":
                lang = lang or got.get("lang")
            elif name == "base" and "href" in got:
                base = got["href"]
            elif name == "meta" and (got.get("name") or got.get("property")):
                metas.append({"name": got.get("name") or got.get("property"), "content": got.get("content", "")})
            elif "href" in got or "src" in got:
                target = got.get("href") or got.get("src") or ""
                links.append({"path": f"{name.upper()}@/{'href' if 'href' in got else 'src'}", "url": _absolute(base, target)})
    out.append(page[at:].replace("\n", " "))
    lines = (line.strip() for line in _BLANKS.sub(" ", html.unescape("".join(out))).split("\n"))
    text = "\n".join(line for line in lines if line)
    return {"title": title, "lang": lang, "links": links, "metas": metas, "text": text}


def _rows(rows: list[dict]) -> pa.RecordBatch:
    text, pairs = pa.string(), pa.map_(pa.string(), pa.string())
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([
        ("record_id", text), ("type", text), ("refers_to", text), ("uri", text), ("date", text), ("headers", pairs), ("block", pa.binary())]))


def _response(page_id, url, body: str, date: str) -> dict:
    payload = body.encode("utf-8", "surrogatepass")
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode() + payload
    uri = url or ""
    return {"record_id": record_id("response", page_id, uri, digest(payload)), "type": "response", "refers_to": None, "uri": uri, "date": date,
            "headers": [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload)),
                        ("WARC-Block-Digest", digest(block)), ("WARC-Source-Id", "" if page_id is None else str(page_id))], "block": block}


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One response record for every page; null pages are empty ones, a null address is an empty one."""
    ship(pages.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch]):
                yield _rows([_response(r["page_id"], r["url"], r["html"] or "", date) for r in part.to_pylist()])
    return pages.select("page_id", "url", "html").mapInArrow(run, RECORD)


def _derive(row: dict) -> list[dict]:
    block = row["block"] or b""
    headers = dict(row["headers"] or [])
    status, pairs, payload = split_http(block)
    source = {k: headers[k] for k in ("WARC-Payload-Digest", "WARC-Block-Digest", "WARC-Source-Id", "Content-Type") if k in headers}
    payload_digest = digest(payload)
    charset = next((m[1] for k, v in pairs if k.lower() == "content-type" and (m := re.search(r"charset=\"?([\w.:-]+)", v))), "utf-8")
    try:
        page = payload.decode(charset, "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    got = extract(page, row["uri"] or "")
    envelope = {"Envelope": {
        "Format": "WARC", "WARC-Header-Metadata": {"WARC-Type": row["type"], "WARC-Record-ID": row["record_id"], "WARC-Target-URI": row["uri"],
                                                   "WARC-Date": row["date"], **source},
        "Payload-Metadata": {"Actual-Content-Length": str(len(block)), "Block-Digest": digest(block), "Payload-Digest": payload_digest,
                             "Digest-Valid": headers.get("WARC-Payload-Digest") in (None, payload_digest),
                             "HTTP-Response-Metadata": {"Status": status, "Headers": pairs, "Entity-Length": str(len(payload)),
                                                        "HTML-Metadata": {"Head": {"Title": got["title"], "Lang": got["lang"], "Metas": got["metas"]},
                                                                          "Links": got["links"]}}}}}
    facts, text = json.dumps(envelope, ensure_ascii=False).encode("utf-8", "replace"), got["text"].encode("utf-8", "replace")

    def derived(kind: str, data: bytes, content: str, more: list) -> dict:
        return {"record_id": record_id(kind, row["record_id"], digest(data)), "type": kind, "refers_to": row["record_id"], "uri": row["uri"], "date": row["date"],
                "headers": [("Content-Type", content), ("WARC-Block-Digest", digest(data)), ("WARC-Source-Payload-Digest", payload_digest),
                            ("WARC-Source-Id", headers.get("WARC-Source-Id", "")), *more], "block": data}
    meta = derived("metadata", facts, "application/json", [("Source-Links", str(len(got["links"])))])
    conversion = derived("conversion", text, "text/plain", [("WARC-Concurrent-To", meta["record_id"])]
                         + ([("WARC-Identified-Content-Language", got["lang"])] if got["lang"] else []))
    return [meta, conversion]


def derive(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for every response record; records of other types give none.

    Both refer to their response by ``WARC-Refers-To`` and carry its payload digest, computed anew; metadata keeps the source's WARC and HTTP
    headers, its links and meta tags as JSON and says whether the stored digest holds. The conversion record is the plain text and names
    the metadata record. Repeated responses give repeated records.
    """
    ship(records.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], 64):
                yield _rows([x for row in part.to_pylist() for x in _derive(row)])
    return records.where("type = 'response'").select(*[c.split()[0] for c in RECORD.split(", ")]).mapInArrow(run, RECORD)


def serialise(row: dict) -> bytes:
    """A record as it stands in a WARC file."""
    block = row["block"] or b""
    fields = [("WARC-Type", row["type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Refers-To", row["refers_to"]), ("WARC-Target-URI", row["uri"]),
              ("WARC-Date", row["date"]), *sorted(dict(row["headers"] or []).items()), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[dict]:
    """The records of an uncompressed WARC file."""
    at = 0
    while (end := data.find(b"\r\n\r\n", at)) >= 0:
        pairs = [x.split(": ", 1) for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]]
        headers = {x[0]: x[1] if len(x) > 1 else "" for x in pairs}
        size = int(headers.pop("Content-Length", 0))
        own = [headers.pop(k, None) for k in ("WARC-Record-ID", "WARC-Type", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date")]
        yield dict(zip(("record_id", "type", "refers_to", "uri", "date"), own, strict=True)) | {
            "headers": list(headers.items()), "block": data[end + 4:end + 4 + size]}
        at = end + 4 + size + 4


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Write ``part-*.warc.gz`` files, one gzip member per record, and return ``file, records``.

    Files get new names in every attempt; the table names those of the attempts that succeeded.
    """
    ship(records.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        name, n, out = f"part-{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    fs.create_dir(path, recursive=True)
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                out.write(gzip.compress(serialise(row), 6, mtime=0))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "records": pa.array([n], pa.int64())})
    return materialise(records.mapInArrow(run, "file string, records long"), "warc-files")


def read_warc(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The records of the files that a table names, one task per file at most."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                fs, path = file_system(name)
                with fs.open_input_stream(path, compression=None) as source:
                    rows = []
                    for row in parse(gzip.decompress(source.read())):
                        rows.append(row)
                        if len(rows) == 256:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)
    return files.select("file").repartition("file").mapInArrow(run, RECORD)


def build_derivatives(pages: DataFrame) -> DataFrame:
    """Pages to responses to derivatives."""
    return derive(responses(pages))

