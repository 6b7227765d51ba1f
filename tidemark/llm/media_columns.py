"""Media columns: interleaved sequences of texts and media references, payloads joined by digest.

A page becomes an ordered array of items, one for each block of text and one for each medium, so a medium's
position and caption stay aligned with the text around it. A reference carries the digest of its payload; the
payloads are a table of their own with one row a digest. Payloads are stored as 8-bit greyscale PNG images,
64 samples wide, and read back bit by bit.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows, materialize

WIDTH = 64
ITEM = "struct<position:int,kind:string,text:string,ref:string,digest:string,caption:string>"
_BLOCKS = {"p", "div", "article", "section", "figure", "figcaption", "li", "ul", "ol", "table", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "br", "hr", "pre", "blockquote", "header", "footer", "main", "nav", "aside", "body", "title"}
_MEDIA = {"img", "audio", "video", "source"}
_SILENT = {"script", "style", "template", "noscript"}
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.buffer: list[str] = []
        self.silent = 0
        self.caption = False
        self.figure: list[int] = []  # media of each open figure start here

    def _close_block(self):
        text = "".join(self.buffer).strip()
        self.buffer.clear()
        if not text:
            return
        if self.caption and self.figure:
            own = [x for x in self.items[self.figure[-1] :] if x["kind"] == "media"]
            if own:
                for x in own:
                    x["caption"] = text
                return
        self.items.append({"kind": "text", "text": text, "ref": None, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        if tag in _BLOCKS or tag in _MEDIA:
            self._close_block()
        if tag == "figure":
            self.figure.append(len(self.items))
        elif tag == "figcaption":
            self.caption = True
        elif tag in _MEDIA:
            named = dict(attrs)
            ref = named.get("src")
            if ref:
                digest = ref[7:].lower() if ref.startswith("sha256:") else None
                self.items.append({"kind": "media", "text": None, "ref": ref, "digest": digest, "caption": named.get("alt") or None})

    def handle_endtag(self, tag):
        if tag in _SILENT and self.silent:
            self.silent -= 1
        if tag in _BLOCKS:
            self._close_block()
        if tag == "figcaption":
            self.caption = False
        elif tag == "figure" and self.figure:
            self.figure.pop()

    def handle_data(self, data):
        if not self.silent:
            self.buffer.append(data)


def parse(page: str | None) -> list[dict]:
    """Items of a page in order, positions from 0. A caption belongs to the media of its figure that come
    before it; a figcaption without any is a text."""
    reader = _Reader()
    reader.feed(page or "")
    reader.close()
    reader._close_block()
    return [{"position": k, **x} for k, x in enumerate(reader.items)]


def sequences(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id_col, items array<position, kind, text, ref, digest, caption>) for each row; a null or empty page
    has no items; rows may repeat; other columns are left out."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"i": pdf["i"], "items": [parse(x) for x in pdf["h"]]})

    return map_rows(df, id_col, {"h": F.col(html_col)}, run, f"items array<{ITEM}>")


def resolve(seqs: DataFrame, payloads: DataFrame, id_col: str = "page_id", digest_col: str = "digest") -> DataFrame:
    """A row for each media item: (id_col, position, n_items, ref, digest, caption, and the columns of
    payloads), null where no payload has the digest. payloads has one row a digest; a digest that very many
    pages share is split by adaptive execution, since both sides of the join are plain tables."""
    media = seqs.select(id_col, F.size("items").alias("n_items"), F.explode("items").alias("item")).where("item.kind = 'media'")
    media = media.select(id_col, "n_items", *(F.col(f"item.{c}").alias(c) for c in ("position", "ref", "digest", "caption")))
    return media.join(payloads.withColumnRenamed(digest_col, "_digest"), F.col("digest") == F.col("_digest"), "left").drop("_digest")


def to_png(samples: bytes, width: int = WIDTH) -> bytes:
    """Greyscale image of 8-bit samples, whose number must be a positive multiple of the width."""
    rows = len(samples) // width
    if rows * width != len(samples) or not rows:
        raise ValueError("samples must fill whole rows")
    lines = np.zeros((rows, width + 1), dtype=np.uint8)  # each line begins with its filter, 0
    lines[:, 1:] = np.frombuffer(samples, dtype=np.uint8).reshape(rows, width)

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The samples of an image that to_png made; ValueError where a checksum or the form is wrong."""
    if image[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, data, width, rows = 8, b"", 0, 0
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        name, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(name + body):
            raise ValueError("a chunk is damaged")
        if name == b"IHDR":
            width, rows, depth, colour = struct.unpack_from(">IIBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("8-bit greyscale is expected")
        elif name == b"IDAT":
            data += body
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(rows, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not expected")
    return lines[:, 1:].tobytes()


def feature(samples: bytes, width: int = WIDTH) -> str:
    """Rows, sum, sum of squares, histogram in 16 bins, and a 64-bit average hash over an 8 by 8 grid; whole
    numbers throughout, so that equal samples give equal features anywhere."""
    x = np.frombuffer(samples, dtype=np.uint8).reshape(-1, width)
    counts = np.bincount(x.ravel(), minlength=256)
    values = np.arange(256)
    total = int(counts @ values)
    bands = np.linspace(0, len(x), 9).astype(np.int64)
    columns = np.concatenate([np.zeros((1, 8), dtype=np.int64), x.reshape(len(x), 8, width // 8).sum(axis=2, dtype=np.int64).cumsum(axis=0)])
    sums = columns[bands[1:]] - columns[bands[:-1]]
    cells = (bands[1:] - bands[:-1])[:, None] * (width // 8)
    bits = (sums * x.size > total * cells).ravel()
    return f"{len(x)}:{total}:{int(counts @ values**2)}:{','.join(map(str, counts.reshape(16, 16).sum(axis=1)))}:{int(np.packbits(bits).view('>u8')[0]):016x}"


def padded(text: str | None) -> bytes:
    b = (text or "").encode("utf-8", "surrogatepass")
    return b + bytes((-len(b)) % WIDTH or (0 if b else WIDTH))


def document_page(text: str | None, digest: str) -> str:
    """A page with the text and, as a figure after it, the medium that holds the text's bytes."""
    n = len((text or "").encode("utf-8", "surrogatepass"))
    return f'<article><p>{html.escape(text or "", quote=False)}</p><figure><img src="sha256:{digest}"><figcaption>{n} bytes</figcaption></figure></article>'


def stored_payloads(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(digest, media): one stored image for each different payload of the texts."""

    def run(batches):
        for pdf in batches:
            seen, digests, media = set(), [], []
            for t in pdf["t"]:
                p = padded(t)
                d = hashlib.sha256(p).hexdigest()
                if d not in seen:
                    seen.add(d)
                    digests.append(d)
                    media.append(to_png(p))
            yield pd.DataFrame({"digest": digests, "media": media})

    return df.select(F.col(text_col).alias("t")).mapInPandas(run, "digest string, media binary").groupBy("digest").agg(F.first("media").alias("media"))


def described_payloads(payloads: DataFrame) -> DataFrame:
    """(digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), all of the
    bytes read back from the stored media."""

    def run(batches):
        for pdf in batches:
            out = []
            for digest, media in zip(pdf["digest"], pdf["media"]):
                p = from_png(media)
                out.append((digest, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(p)))
            yield pd.DataFrame(out, columns=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return payloads.mapInPandas(run, "digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def document_sequences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, text_chars, n_items, position, ref, digest, caption): the sequence of each
    document's page, with its medium. The text of the sequence is only measured here, not kept."""

    def run(batches):
        for pdf in batches:
            out = []
            for i, t in zip(pdf["i"], pdf["t"]):
                digest = hashlib.sha256(padded(t)).hexdigest()
                items = parse(document_page(t, digest))
                chars = sum(len(x["text"]) for x in items if x["kind"] == "text")
                n = len((t or "").encode("utf-8", "surrogatepass"))
                out += [(i, n, chars, len(items), x["position"], x["ref"], x["digest"], x["caption"]) for x in items if x["kind"] == "media"]
            yield pd.DataFrame(out, columns=["i", "n_bytes", "text_chars", "n_items", "position", "ref", "digest", "caption"])

    return map_rows(df, id_col, {"t": F.col(text_col)}, run, "n_bytes bigint, text_chars bigint, n_items bigint, position bigint, ref string, digest string, caption string")


def document_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, what described_payloads has, position, n_items, text_chars, caption) for each row.

    A null text is empty; an empty one has a payload of 64 zero bytes. Rows may repeat, equal texts give
    equal values, a null id stays, other columns are left out.
    """
    store = materialize(described_payloads(stored_payloads(df, text_col)), "media-described")
    seqs = document_sequences(df, id_col, text_col).withColumnRenamed("digest", "_digest")
    out = seqs.join(store, F.col("_digest") == F.col("digest"), "left")
    return out.select(id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "n_items", "text_chars", "caption")
