"""Interleaved document sequences: HTML with media references, resolved by digest against a media table."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blobs, pieces, strings

WIDTH = 64
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
_TAG = re.compile(r"<!--.*?-->|<![^>]*>|<(script|style|template|noscript)\b[^>]*>.*?</\1\s*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_ATTR = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_BREAK = {"p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "header", "footer", "nav", "table", "tr", "td", "th", "blockquote", "pre", "body", "main", "aside", "title"}
_MEDIA = {"img", "audio", "video", "source"}


def parse_html(html: str | None) -> list[tuple[int, str, str | None, str | None, str | None]]:
    """Ordered items (position, kind, text, digest, caption) of a page: text blocks and media references.

    A reference's digest is its data-sha256, or the hex in a src like sha256:HEX, else null; its caption is the
    figcaption of the figure around it, else its alt. Text of a figcaption stands with its reference only.
    """
    out: list[list] = []
    buffer: list[str] = []
    figure: list[int] | None = None
    caption: list[str] | None = None

    def flush() -> None:
        text = re.sub(r"[\x20\x09-\x0D]+", " ", "".join(buffer)).strip(" ")
        buffer.clear()
        if text:
            out.append([len(out), "text", text, None, None])

    at, html = 0, html or ""
    for m in _TAG.finditer(html):
        (buffer if caption is None else caption).append(unescape(html[at : m.start()]))
        at = m.end()
        name, closing = (m[3] or "").lower(), bool(m[2])
        if name == "figcaption":
            if not closing:
                flush()
                caption = []
            elif caption is not None:
                said = re.sub(r"[\x20\x09-\x0D]+", " ", "".join(caption)).strip(" ")
                caption = None
                for k in figure or []:
                    out[k][4] = said or out[k][4]
        elif name == "figure":
            flush()
            figure = None if closing else []
        elif name in _MEDIA and not closing:
            flush()
            attrs = {k.lower(): unescape(a or b or c) for k, a, b, c in _ATTR.findall(m[4])}
            named = re.search(r"sha256[:-]([0-9a-f]{64})", attrs.get("src", ""))
            if figure is not None:
                figure.append(len(out))
            out.append([len(out), name, None, attrs.get("data-sha256") or (named[1] if named else None), attrs.get("alt")])
        elif name == "br":
            (buffer if caption is None else caption).append(" ")
        elif name in _BREAK and caption is None:
            flush()
    buffer.append(unescape(html[at:]))
    flush()
    return [tuple(x) for x in out]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
    keys = ("position", "kind", "text", "digest", "caption")
    for batch in batches:
        for i in range(0, len(batch), 256):
            part = batch.slice(i, 256)
            items = [[dict(zip(keys, x, strict=True)) for x in parse_html(h)] for h in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(items, kind)], names=["page", "items"])


def sequences(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(page, items): each page's ordered text and media-reference structs. Null or empty html: no items."""
    return pages.select(F.col(id_col).cast("long").alias("page"), F.col(html_col).alias("html")).mapInArrow(_parse, f"page long, items {SEQUENCE}")


def encode_pgm(payload: Column, width: int = WIDTH) -> Column:
    """A binary grey image of the bytes, a sample a byte; their number must be a multiple of width."""
    header = F.concat(F.lit(f"P5\n{width} "), (F.octet_length(payload) / width).cast("long").cast("string"), F.lit("\n255\n"))
    return F.concat(header.cast("binary"), payload)


def text_payload(text: Column, width: int = WIDTH) -> Column:
    """UTF-8 bytes of a text (null: none), then bytes 0 up to a positive multiple of width."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    short = F.greatest(F.lit(width), F.ceil(F.octet_length(data) / width) * width).cast("int") - F.octet_length(data)
    return F.concat(data, F.expr(f"unhex(repeat('00', {width}))").substr(F.lit(1), short))


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decodes stored images; their digest, the payload's, its last row's checksum, and features of its samples."""
    for batch in batches:
        column = batch.column(0).cast(pa.large_binary())
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        memory = memoryview(column.buffers()[2])
        out = []
        for s, e in zip(at[:-1], at[1:], strict=True):
            stored = memory[s:e]
            magic, size, depth = bytes(stored[:64]).split(b"\n", 3)[:3]
            width, height = map(int, size.split())
            if magic != b"P5" or depth != b"255":
                raise ValueError("not an 8-bit grey image")
            payload = stored[len(magic) + len(size) + len(depth) + 3 :]
            if len(payload) != width * height:
                raise ValueError("the image is cut")
            samples = np.frombuffer(payload, np.uint8)
            counts = np.bincount(samples, minlength=256)
            share = counts[counts > 0] / len(samples)
            step = int(np.abs(np.diff(samples.astype(np.int16))).sum(dtype=np.int64))
            total = int(samples.sum(dtype=np.int64))
            feature = f"w{width}h{height};sum={total};step={step};levels={len(share)};entropy={-(share * np.log2(share)).sum() + 0.0:.6f};peak={int(counts.argmax())}"
            out.append((hashlib.sha256(stored).hexdigest(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), feature))
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"])


FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string"
HOT, SALTS = 200, 64


def resolved(digests: DataFrame, media: DataFrame, media_col: str = "media") -> DataFrame:
    """(digest, media): the stored bytes of each different digest, left out where `media` has none. Equal images are combined before they are shuffled."""
    store = media.select(F.sha2(media_col, 256).alias("digest"), F.col(media_col).alias("media")).filter("media is not null")
    store = store.groupBy("digest").agg(F.first("media").alias("media"))
    return store.join(digests.select("digest").distinct(), "digest", "left_semi")


def interleave(pages: DataFrame, media: DataFrame, id_col: str, html_col: str, media_col: str = "media") -> DataFrame:
    """One row per item of a page's sequence: id, position, kind, text, caption, digest and the features of its media.

    Items keep their positions and captions. A reference's digest is joined to the stored bytes, those are
    decoded where they lie, once for each different digest, and their features join the items; a digest that
    `media` lacks, or a reference without one, leaves the features null. Digests that more than one in HOT
    references name (so fewer than HOT of them) are dealt over SALTS keys. Null media are left out; an image that
    isn't whole fails. Null or empty html: no rows. Null ids stay. Repeated pages give repeated rows, repeated
    media count once. Other columns are not read. Empty tables give an empty result.
    """
    scratch = Scratch(pages.sparkSession)
    items = scratch.save(sequences(pages, id_col, html_col).select(F.col("page").alias(id_col), F.explode("items").alias("i")).select(id_col, "i.*"))
    named = scratch.save(items.filter("digest is not null").groupBy("digest").agg(F.count("*").alias("n")))
    features = resolved(named, media, media_col).select("media").mapInArrow(_read_back, FEATURES)
    total = named.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(named.filter(F.col("n") > total / HOT).select("digest", F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(0)
    features = features.join(hot, "digest", "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
    return items.join(hot, "digest", "left").withColumn("salt", salt).join(features, ["digest", "salt"], "left").drop("hot", "salt")


def payloads(items: DataFrame, media: DataFrame, media_col: str = "media") -> DataFrame:
    """Items with a digest, each with the stored bytes it names (null if `media` has none). Repeated media count once."""
    items = items.filter("digest is not null")
    return items.join(resolved(items, media, media_col), "digest", "left")


def document_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a stored image, on a page that refers to it: id, media, html."""
    stored = docs.select(F.col(id_col).cast("long").alias(id_col), encode_pgm(text_payload(F.col(text_col))).alias("media"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("string").alias("n"))
    html = F.concat(F.lit('<article><p>Document</p><figure><img src="sha256:'), F.sha2("media", 256), F.lit('" alt="text"><figcaption>'), F.col("n"), F.lit(" bytes</figcaption></figure></article>"))
    return stored.select(id_col, "media", html.alias("html"))
