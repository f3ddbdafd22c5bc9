"""WARC derivatives: linked metadata and plain-text conversion records from response records.

Every response gives one `metadata` record (page title, links, HTTP headers and digests of the source, as
application/warc-fields) and one `conversion` record (the page as plain text). Both name the response in
WARC-Refers-To and keep its target URI and date; the metadata also names the conversion in WARC-Concurrent-To.
Record ids are derived from the response id, so a repeated task writes the same records. All work is done row by
row in the scan; nothing is shuffled.

`write_warc` writes records as files, `read_warc` reads such files back (one file per task, so keep files below
about a GB, as crawls do), and `responses` turns a table of pages into response records.

Edge cases: a null body is an empty one, and gives an empty text; a null url leaves the target URI out; bytes that
are no UTF-8 are decoded by the charset of the HTTP header or else with replacement characters; repeated rows give
repeated records; columns of the input that are not named here are not read.
"""

import base64
import hashlib
import html
import re
import uuid
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "WARC/1.1"
#: Date of the responses made from a table that has none.
FETCHED = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("5b1c3a4e-6f0d-5e55-9a57-0d3c1f5c2b11")
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|title)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|caption|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr"
    r"|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)\b[^>]*>",
    re.I,
)
_TAG = re.compile(r"<[A-Za-z/!?][^>]*>")
_BLANKS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(r"<title\b[^>]*>", re.I)
_TITLE_END = re.compile(r"</title\s*>", re.I)
_ANCHOR = re.compile(r"<a\b", re.I)
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_OPEN_HREF = re.compile(r"\bhref\s*=\s*[\"']", re.I)
_CHARSET = re.compile(r"charset\s*=\s*\"?([\w\-]+)", re.I)

RECORD = T.StructType(
    [
        T.StructField("warc_type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("concurrent_to", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("warc_date", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("content_length", T.LongType()),
        T.StructField("block_digest", T.StringType()),
        T.StructField("source_payload_digest", T.StringType()),
        T.StructField("source_block_digest", T.StringType()),
        T.StructField("block", T.BinaryType()),
    ]
)


def digest(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def named(*parts):
    """A record id that depends on nothing but the parts."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(parts))}>"


def _without(pattern, by, page):
    """The page with all tags of a pattern replaced. Nothing after the last `>` can be one, so it is not looked through."""
    end = page.rfind(">") + 1
    return pattern.sub(by, page[:end]) + page[end:]


def plain_text(page):
    """The visible text of an HTML page: a line per block, white space collapsed."""
    page = _HIDDEN.sub(" ", page)
    page = _without(_TAG, "", _without(_BREAK, "\n", page))
    page = _BLANKS.sub(" ", html.unescape(page))
    return _LINES.sub("\n", page).strip()


def title_of(page):
    found = _TITLE.search(page, 0, page.rfind(">") + 1)
    if not found:
        return ""
    end = _TITLE_END.search(page, found.end())
    return " ".join(html.unescape(page[found.end() : end.start() if end else len(page)]).split())


def hrefs(page):
    """Targets of the anchors as they stand, by one pass: an anchor reaches to its `>`, and so does the search for the next."""
    at, last = 0, page.rfind(">")
    while found := _ANCHOR.search(page, at):
        end = page.find(">", found.end()) if found.end() <= last else len(page)
        # A value may hold the `>` that seems to end its anchor.
        target = _HREF.search(page, found.end(), end)
        opened = target or _OPEN_HREF.search(page, found.end(), end)
        if opened and not target:
            target = _HREF.match(page, opened.start())
        if target:
            yield "".join(group or "" for group in target.groups())
        at = max(end, target.end() if target else end)


def links_of(page, base):
    """Absolute targets of the links, in order, each once."""
    out = {}
    for href in hrefs(page):
        target = html.unescape(href).strip()
        try:
            out[urljoin(base, target)] = None
        except ValueError:  # not a url at all
            continue
    return list(out)


def split_http(block):
    """(status line, header pairs, payload) of an HTTP response block."""
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    pairs = [(name.strip(), value.strip()) for name, _, value in (line.partition(":") for line in lines if line)]
    return status, pairs, payload


def decoded(payload, content_type):
    found = _CHARSET.search(content_type)
    try:
        return payload.decode(found[1] if found else "utf-8")
    except (LookupError, UnicodeError):
        return payload.decode("utf-8", errors="replace")


def fields(pairs):
    """application/warc-fields: a line per pair, line breaks inside values as spaces."""
    return "".join(f"{name}: {' '.join(value.split())}\r\n" for name, value in pairs).encode(errors="replace")


def derivatives(record_id, target, date, block):
    """The metadata and the conversion record of one response, as rows of RECORD."""
    status, pairs, payload = split_http(block)
    content_type = next((v for n, v in pairs if n.lower() == "content-type"), "")
    page = decoded(payload, content_type)
    text = plain_text(page).encode(errors="replace")
    meta_id, text_id = named("metadata", record_id), named("conversion", record_id)
    payload_digest, block_digest = digest(payload), digest(block)
    said = [
        ("title", title_of(page)),
        ("http-status", status),
        *[(f"http-header-{n.lower()}", v) for n, v in pairs],
        ("source-payload-digest", payload_digest),
        ("source-block-digest", block_digest),
        ("source-length", str(len(block))),
        ("conversion-digest", digest(text)),
        *[("outlink", f"{link} L a/@href") for link in links_of(page, target or "")],
    ]
    meta = fields(said)
    for kind, own_id, other, what, data in (
        ("metadata", meta_id, text_id, "application/warc-fields", meta),
        ("conversion", text_id, None, "text/plain; charset=utf-8", text),
    ):
        yield (kind, own_id, record_id, other, target, date, what, len(data), digest(data), payload_digest, block_digest, data)


def responses(pages, id_col="page_id", url_col="url", body_col="html", date=FETCHED):
    """Response records of a table of pages: id, record_id, target_uri, warc_date and the HTTP block."""
    body = F.coalesce(F.col(body_col).cast("binary"), F.lit(b""))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    name = F.md5(F.concat_ws("\x00", F.col(id_col).cast("string"), F.col(url_col), F.lit(date), F.sha1(body)))
    parts = [F.substring(name, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return pages.select(
        F.col(id_col),
        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"),
        F.col(url_col).alias("target_uri"),
        F.lit(date).alias("warc_date"),
        F.concat(head.cast("binary"), body).alias("block"),
    )


def derive(found, id_col=None):
    """Two records per response, after RECORD; with id_col also that column of the response."""
    own = ["record_id", "target_uri", "warc_date", "block"]
    schema = T.StructType(([found.schema[id_col]] if id_col else []) + RECORD.fields)
    kinds = [pa.string()] * 7 + [pa.int64()] + [pa.string()] * 3 + [pa.binary()]

    def run(batches):
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(4)]
            rows, source = [], []
            for i, row in enumerate(zip(*columns)):
                made = list(derivatives(*row[:3], row[3] or b""))
                rows += made
                source += [i] * len(made)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)]
            if id_col:
                columns.insert(0, batch.column(4).take(pa.array(source, pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return found.select(*own, *([id_col] if id_col else [])).mapInArrow(run, schema)


def _header(name, column):
    return F.when(column.isNotNull(), F.concat(F.lit(name + ": "), column, F.lit("\r\n"))).otherwise(F.lit(""))


def serialized(records):
    """Each record as the bytes of a WARC file, without the two line ends that close it."""
    head = F.concat(
        F.lit(VERSION + "\r\n"),
        _header("WARC-Type", F.col("warc_type")),
        _header("WARC-Record-ID", F.col("record_id")),
        _header("WARC-Refers-To", F.col("refers_to")),
        _header("WARC-Concurrent-To", F.col("concurrent_to")),
        _header("WARC-Target-URI", F.col("target_uri")),
        _header("WARC-Date", F.col("warc_date")),
        _header("WARC-Block-Digest", F.col("block_digest")),
        _header("WARC-Source-Payload-Digest", F.col("source_payload_digest")),
        _header("WARC-Source-Block-Digest", F.col("source_block_digest")),
        _header("Content-Type", F.col("content_type")),
        F.lit("Content-Length: "),
        F.col("content_length").cast("string"),
        F.lit("\r\n\r\n"),
    )
    return records.select(F.concat(head.cast("binary"), F.col("block")).alias("value"))


def write_warc(records, path, compression="gzip"):
    """Records as .warc files (gzip members may span records), one per task."""
    text = serialized(records).select(F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def parsed(data):
    """(header dict, block) of all records in the bytes of a WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        header = dict(line.split(": ", 1) for line in lines)
        begin = end + 4
        at = begin + int(header["Content-Length"])
        yield header, data[begin:at]
        at += 4


def read_warc(spark, path):
    """Records of uncompressed or gzip files: header map and block."""
    import gzip

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                data = raw.as_py()
                rows = list(parsed(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([list(h.items()) for h, _ in rows], pa.map_(pa.string(), pa.string())),
                        pa.array([b for _, b in rows], pa.binary()),
                    ],
                    ["header", "block"],
                )

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "header map<string,string>, block binary")


def report(pages):
    """Both records of every page's response."""
    return derive(responses(pages), "page_id")
