"""WARC derivatives: linked metadata and plain-text conversion records of responses.

Each response gives a ``metadata`` record (JSON about its headers, title, metas and
links) and a ``conversion`` record (its plain text). Both refer to the response by
its id and carry its headers and digests; their own ids are made from the response's
id and the record type, so a re-run gives the same records.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Possessive runs never give back what they took, so a tag that does not close is read once.
_TAG = re.compile(r"<!--|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*+)>|<[!?][^<>]*+>")
_ATTRIBUTE = re.compile(r"(?<![\w:-])([a-zA-Z][\w:-]*+)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
#: Elements whose content is no text, and those that end a line.
_RAW = frozenset("script style noscript template textarea svg iframe".split())
_LINE = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table td th title tr ul body".split())
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW | {"title"}}
_LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "source": "src"}
CRLF = "\r\n"


def sha1_digest(data: bytes) -> str:
    """A digest as WARC headers have it: ``sha1:`` and base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def parse_html(page: str) -> tuple[str, str | None, list[dict], list[dict]]:
    """Plain text, title, metas and links of a page, in one pass that is linear whatever the markup."""
    text, metas, links, title, at = [], [], [], None, 0
    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        text.append(page[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            end = page.find("-->", at)
            at = end + 3 if end >= 0 else len(page)
            continue
        if m[2] is None:
            continue
        name = m[2].lower()
        if name in _LINE:
            text.append("\n")
        if m[1]:
            continue
        if name in _LINKS or name == "meta":
            own = {a[1].lower(): entities.unescape(a[2] if a[2] is not None else a[3] if a[3] is not None else a[4]) for a in _ATTRIBUTE.finditer(m[3])}
            if name == "meta" and own:
                metas.append(own)
            elif own.get(_LINKS.get(name)):
                links.append({"path": f"{name.upper()}@/{_LINKS[name]}", "url": own[_LINKS[name]]})
        if name in _RAW or name == "title":
            close = _CLOSE[name].search(page, at)
            end = close.start() if close else len(page)
            if name == "title" and title is None:
                title = " ".join(entities.unescape(page[at:end]).split())
            at = close.end() if close else len(page)
    text.append(page[at:])
    lines = (" ".join(x.split()) for x in entities.unescape("".join(text)).split("\n"))
    return "\n".join(x for x in lines if x), title, metas, links


def responses_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of raw pages: ``page_id, record_id, target_uri, warc_date, http_headers, payload``."""
    key = F.md5(F.concat_ws("\n", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(url_col), F.lit(""))))
    cut = F.regexp_replace(key, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    headers = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"
    return pages.select(F.col(id_col).alias("page_id"), F.concat(F.lit("<urn:uuid:"), cut, F.lit(">")).alias("record_id"), F.col(url_col).alias("target_uri"), F.lit(date).alias("warc_date"), F.lit(headers).alias("http_headers"), F.col(html_col).alias("payload"))


def _headers(block: str) -> tuple[str, list[list[str]]]:
    lines = block.replace(CRLF, "\n").split("\n")
    pairs = [line.split(":", 1) for line in lines[1:] if ":" in line]
    return lines[0], [[k.strip(), v.strip()] for k, v in pairs]


def _decoded(body: bytes, pairs: list[list[str]]) -> str:
    """The payload as text, by the charset of its Content-Type header, else of its first 1024 bytes, else UTF-8."""
    declared = next((v for k, v in pairs if k.lower() == "content-type"), "")
    found = _CHARSET.search(declared) or _CHARSET.search(body[:1024].decode("latin-1"))
    try:
        return body.decode(found[1] if found else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def derive(record_id: str | None, uri: str | None, date: str | None, headers: str | None, payload: str | bytes | None, payload_digest: str | None = None, block_digest: str | None = None) -> list[tuple]:
    """The metadata and the conversion record of a response; digests that the response has are kept, others are computed."""
    record_id, uri, date, headers, payload = (x or "" for x in (record_id, uri, date, headers, payload))
    status, pairs = _headers(headers)
    body = bytes(payload) if isinstance(payload, (bytes, bytearray)) else payload.encode("utf-8", "replace")
    block = (headers + CRLF * 2).encode("utf-8", "replace") + body if headers else body
    payload_digest, block_digest = payload_digest or sha1_digest(body), block_digest or sha1_digest(block)
    text, title, metas, links = parse_html(payload if isinstance(payload, str) else _decoded(body, pairs))
    about = {
        "WARC-Header-Metadata": {"WARC-Type": "response", "WARC-Record-ID": record_id, "WARC-Target-URI": uri, "WARC-Date": date, "WARC-Payload-Digest": payload_digest, "WARC-Block-Digest": block_digest, "Content-Length": str(len(block))},
        "Payload-Metadata": {"HTTP-Response-Metadata": {"Response-Message": status, "Headers": pairs, "Entity-Length": len(body), "Entity-Digest": payload_digest, "HTML-Metadata": {"Title": title, "Metas": metas, "Links": links}}},
    }
    out = []
    for kind, media, content in (("metadata", "application/json", json.dumps({"Envelope": about}, ensure_ascii=False, separators=(",", ":"))), ("conversion", "text/plain", text)):
        data = content.encode("utf-8", "replace")
        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record_id}#{kind}')}>"
        out.append((kind, own, record_id, uri, date, media, len(data), sha1_digest(data), payload_digest, block_digest, headers, content))
    return out


#: Digests that a response may bring along.
DIGESTS = ("payload_digest", "block_digest")
FIELDS = ("warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "content_length", "block_digest", "source_payload_digest", "source_block_digest", "source_headers", "content")


def derivatives(responses: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Two rows per response: the ``keep`` columns and ``FIELDS`` of its records.

    Input columns: ``record_id, target_uri, warc_date, http_headers, payload`` (text or
    binary); a null one counts as empty, so a response without a payload has an empty
    text. ``payload_digest`` and ``block_digest``, if there, are kept where not null.
    Repeated responses give repeated records with equal ids; markup that never
    closes (scripts, comments, tags) is read to the end once; an empty table gives
    an empty result. Other columns are not read.
    """
    rows = responses.select(*keep, "record_id", "target_uri", "warc_date", "http_headers", "payload", *(c for c in DIGESTS if c in responses.columns))
    given = [c for c in DIGESTS if c in responses.columns]
    types = [pa.string()] * 6 + [pa.int64()] + [pa.string()] * 5

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pa.default_memory_pool().release_unused()
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                found = [r for x in zip(*(c.to_pylist() for c in part.columns[len(keep) :])) for r in derive(*x[:5], **dict(zip(given, x[5:])))]
                twice = pa.array([k for k in range(part.num_rows) for _ in (0, 1)])
                yield pa.RecordBatch.from_arrays([*(c.take(twice) for c in part.columns[: len(keep)]), *(pa.array(list(c), t) for c, t in zip(zip(*found), types))], names=[*keep, *FIELDS])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]]
    return rows.mapInArrow(build, ", ".join([*schema, *(f"{c} {'long' if c == 'content_length' else 'string'}" for c in FIELDS)]))


#: Header fields of a written record. The source's digests and headers have names of their own, as the record's are about its own block.
NAMED = (
    ("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"),
    ("X-Source-Payload-Digest", "source_payload_digest"), ("X-Source-Block-Digest", "source_block_digest"), ("X-Source-HTTP-Headers", "source_headers"), ("Content-Type", "content_type"),
)


def _one_line(value: Column) -> Column:
    """A header value without line ends: percent signs and line ends are percent-encoded where there is a line end."""
    return F.when(value.rlike("[\r\n]"), F.replace(F.replace(F.replace(value, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))).otherwise(value)


def record_text() -> Column:
    """A derivative as a WARC record, without the two line ends after it."""
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    value = lambda c: F.coalesce(_one_line(F.col(c)), F.lit(""))
    return F.concat(F.lit(f"WARC/1.0{CRLF}"), *(field(k, value(c)) for k, c in NAMED), field("Content-Length", F.col("content_length").cast("string")), F.lit(CRLF), F.col("content"))


def _store(path: str):
    """A store that pyarrow knows, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path) if "://" in path or path.startswith("file:") else "file://" + path)


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write derivatives as WARC files, one for each partition; an existing folder is an error.

    With ``gzip``, every record is a gzip member of its own, as readers that seek
    expect. A task writes a file under a name of its own, and only files of tasks that
    succeeded are moved into place, so lost executors leave no half records.
    """
    if compression != "gzip":
        records.select(record_text().alias("value")).write.option("lineSep", CRLF * 2).option("compression", compression).text(path)
        return
    import gzip

    store, root = _store(path)
    if store.get_file_info(root).type.name != "NotFound":
        raise ValueError(f"{path} exists")
    staging = f"{root}/_temporary"
    store.create_dir(staging)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        n, out = 0, None
        for batch in batches:
            for value in batch.column(0).to_pylist():
                if out is None:
                    out = _store(path)[0].open_output_stream(f"{staging}/{name}", compression=None)
                out.write(gzip.compress(value.encode("utf-8", "replace") + (CRLF * 2).encode(), 6, mtime=0))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], names=["name", "n"])

    for row in records.select(record_text().alias("value")).mapInArrow(write, "name string, n long").collect():  # a row for each file
        store.move(f"{staging}/{row['name']}", f"{root}/{row['name']}")
    store.delete_dir(staging)
    with store.open_output_stream(f"{root}/_SUCCESS"):
        pass


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and content of each record of an uncompressed WARC stream, one at a time."""
    while line := stream.readline():
        if not line.strip():
            continue
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").strip().partition(":")
            headers[name] = value.strip()
        yield headers, stream.read(int(headers["Content-Length"]))


def read_warc(spark: SparkSession, path: str, binary: bool = False) -> DataFrame:
    """``headers`` (a map) and ``content`` of every record of WARC files, gzipped or not; a task streams whole files, record by record.

    With ``binary``, the content is bytes, as responses need it.
    """
    import gzip
    import io

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.binary() if binary else pa.string()
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, at = _store(name)
                raw = io.BufferedReader(store.open_input_file(at), 1 << 20)
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if raw.peek(2)[:2] == b"\x1f\x8b" else raw
                for headers, data in _records(stream):
                    content = data if binary else data.decode("utf-8", "replace")
                    yield pa.RecordBatch.from_arrays([pa.array([list(headers.items())], pa.map_(pa.string(), pa.string())), pa.array([content], kind)], names=["headers", "content"])

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInArrow(read, f"headers map<string,string>, content {'binary' if binary else 'string'}")


def stored_responses(records: DataFrame) -> DataFrame:
    """The responses of ``read_warc(..., binary=True)`` as input of ``derivatives``: bytes, headers and digests as they were stored."""
    own = records.filter(F.lower(F.col("headers")["WARC-Type"]) == "response")
    # a block is text in ISO 8859-1 where it is cut, so that characters are bytes
    cut = F.instr(F.decode("content", "ISO-8859-1"), CRLF * 2)
    head = lambda name: F.col("headers")[name]
    return own.select(
        head("WARC-Record-ID").alias("record_id"), head("WARC-Target-URI").alias("target_uri"), head("WARC-Date").alias("warc_date"),
        F.when(cut > 0, F.decode(F.substr("content", F.lit(1), cut - 1), "UTF-8")).otherwise("").alias("http_headers"),
        F.when(cut > 0, F.substr("content", cut + 4)).otherwise(F.col("content")).alias("payload"),
        head("WARC-Payload-Digest").alias("payload_digest"), head("WARC-Block-Digest").alias("block_digest"),
    )
