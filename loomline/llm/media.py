"""Interleaved document sequences and their media columns.

HTML becomes an ordered array of text and media-reference structs; references
name payloads by SHA-256 digest and a join on that digest resolves them, so that
positions and captions stay aligned with what was resolved. Payload bytes are
stored as 8-bit grey samples in binary PGM, 64 samples a row, and read back.
The join moves digests and features only; payloads are never shuffled.

Defined results: null text is an empty payload of 64 zero bytes; null or empty
HTML gives an empty sequence, and malformed HTML what can be read of it; an unknown digest keeps its place with a null
payload; repeated rows and equal payloads get equal values; an empty table gives
an empty table. Extra columns are not carried.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import materialise

WIDTH = 64
MEDIA_TAGS = {"img", "video", "audio", "source"}
VOID_TAGS = {"script", "style"}
BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "tr", "article", "table", "section"}
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"


def pad(raw: bytes) -> bytes:
    """raw and zero bytes up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def to_pgm(payload: bytes) -> bytes:
    """8-bit binary PGM, 64 samples wide."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def from_pgm(stored: bytes) -> np.ndarray:
    """The samples of a binary PGM, as rows."""
    head = re.match(rb"P5\s+(\d+)\s+(\d+)\s+255\s", stored)
    if not head:
        raise ValueError("not an 8-bit binary PGM")
    width, height = int(head[1]), int(head[2])
    return np.frombuffer(stored, np.uint8, width * height, head.end()).reshape(height, width)


def features(samples: np.ndarray) -> str:
    """Size, extremes, sum and an eight-bin histogram; integers only, so equal on every machine."""
    bins = np.bincount(samples.ravel() >> 5, minlength=8)
    return f"{samples.shape[1]}x{samples.shape[0]};min={samples.min()};max={samples.max()};sum={int(samples.sum(dtype=np.int64))};hist={','.join(map(str, bins))}"


class _Interleaver(HTMLParser):
    """Text runs and media references in document order; a figcaption belongs to all media of its figure, before and after it.

    A caption ends at its end tag, at the end of its figure, at another figure or
    caption, at a block that begins after some of its text, or with the document.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.figure: list[dict] | None = None
        self.words: str | None = None
        self.hidden = 0

    def flush(self) -> None:
        run = " ".join("".join(self.text).split())
        self.text = []
        if run:
            self.items.append({"position": len(self.items), "kind": "text", "text": run, "digest": None, "caption": None})

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A marked section of unknown kind is passed over, as browsers do."""
        return self.parse_bogus_comment(i)

    def end_caption(self) -> None:
        if self.caption is not None:
            self.words = " ".join("".join(self.caption).split()) or self.words
            self.caption = None
            for item in self.figure or []:
                item["caption"] = self.words or item["caption"]

    def begin_figure(self, figure: list[dict] | None) -> None:
        self.end_caption()
        self.flush()
        self.figure, self.words = figure, None

    def close(self) -> None:
        super().close()
        self.end_caption()
        self.flush()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        named = dict(attrs)
        if tag in BLOCKS and self.caption is not None and "".join(self.caption).strip():
            self.end_caption()
        if tag in VOID_TAGS:
            self.hidden += 1
        elif tag == "figure":
            self.begin_figure([])
        elif tag == "figcaption" and self.figure is not None:
            self.end_caption()
            self.caption = []
        elif tag in MEDIA_TAGS and named.get("src"):
            self.flush()
            source = named["src"]
            item = {"position": len(self.items), "kind": "media", "text": None, "digest": source.removeprefix("sha256:"), "caption": self.words or named.get("alt")}
            self.items.append(item)
            if self.figure is not None:
                self.figure.append(item)
        elif tag in BLOCKS or tag == "br":
            self.text.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID_TAGS:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption":
            self.end_caption()
        elif tag == "figure":
            self.begin_figure(None)
        elif tag in ("p", "div", "article"):
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def interleave(html: str | None) -> list[dict]:
    """The ordered items of one page."""
    parser = _Interleaver()
    parser.feed(html or "")
    parser.close()
    return parser.items


def parse_pages(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key and sequence, for every page."""
    slim = pages.select(F.col(key).alias("page_key"), F.col(html).alias("html"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([interleave(x) for x in b.column(1).to_pylist()], kind)], names=["page_key", "sequence"])

    item = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])
    kind = pa.list_(item)
    return slim.mapInArrow(parse, f"page_key {slim.schema['page_key'].dataType.simpleString()}, sequence {SEQUENCE}")


def references(sequences: DataFrame) -> DataFrame:
    """One row per media reference: page_key, position, digest, caption."""
    item = sequences.select("page_key", F.explode("sequence").alias("m")).filter("m.kind = 'media'")
    return item.select("page_key", "m.position", "m.digest", "m.caption")


def resolve(refs: DataFrame, media: DataFrame) -> DataFrame:
    """References with the columns of media (one row per digest); an unknown digest keeps its row."""
    return refs.join(media, "digest", "left")


def store_texts(docs: DataFrame) -> DataFrame:
    """The media store of documents' texts: doc_id, n_bytes, digest of the padded payload, media (PGM)."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = [x or b"" for x in b.column(1).to_pylist()]
            payloads = [pad(x) for x in raws]
            columns = [b.column(0), pa.array(map(len, raws), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in payloads]), pa.array(map(to_pgm, payloads), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "digest", "media"])

    slim = docs.select("doc_id", F.col("text").cast("binary").alias("raw"))
    return materialise(slim.mapInArrow(store, "doc_id long, n_bytes long, digest string, media binary"))


def read_back(stored: DataFrame) -> DataFrame:
    """What the stored bytes say: payload size, hash and tail CRC, media size and hash, and the feature string."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = b.column(1).to_pylist()
            samples = [from_pgm(x) for x in blobs]
            bodies = [x.tobytes() for x in samples]
            columns = [
                b.column(0),
                pa.array(map(len, bodies), pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in bodies]),
                pa.array([zlib.crc32(x[-WIDTH:]) for x in bodies], pa.int64()),
                pa.array(map(len, blobs), pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in blobs]),
                pa.array(map(features, samples)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    found = stored.select("digest", "media").mapInArrow(read, schema)
    # one row per digest; written, so that the join deals out both sides and can split a hot digest
    return materialise(found.groupBy("digest").agg(*[F.first(n).alias(n) for n in names[1:]]))


def document_media(docs: DataFrame) -> DataFrame:
    """Every document as a page with its text as media: store, parse the page, resolve by digest."""
    stored = store_texts(docs)
    page = F.concat(F.lit("<article><p>Text of one document.</p><figure><img src=\"sha256:"), F.col("digest"), F.lit("\" alt=\"text\"><figcaption>"), F.col("n_bytes").cast("string"), F.lit(" bytes</figcaption></figure></article>"))
    refs = references(parse_pages(stored.select("doc_id", page.alias("html")), "doc_id", "html"))
    out = resolve(refs, read_back(stored))
    return out.select(
        F.col("page_key").alias("doc_id"), F.regexp_extract("caption", r"^(\d+)", 1).cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption"
    )


def page_sequences(pages: DataFrame) -> DataFrame:
    """What the html of every page holds: page_id, n_text and n_media items, words of its text and a digest of the whole sequence.

    The digest is the SHA-256 of the items in order, as lines of kind, text or
    media name, and caption. A null page is an empty sequence.
    """
    of = lambda kind: F.filter("sequence", lambda x: x["kind"] == kind)
    lines = F.transform("sequence", lambda x: F.concat_ws("|", x["kind"], F.coalesce(x["text"], x["digest"], F.lit("")), F.coalesce(x["caption"], F.lit(""))))
    words = F.aggregate(of("text"), F.lit(0).cast("long"), lambda n, x: n + F.size(F.split(x["text"], " ")))
    return parse_pages(pages, "page_id", "html").select(
        F.col("page_key").alias("page_id"), F.size(of("text")).cast("long").alias("n_text"), F.size(of("media")).cast("long").alias("n_media"), words.alias("n_words"), F.sha2(F.array_join(lines, "\n"), 256).alias("sequence_sha256")
    )
