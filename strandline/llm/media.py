"""Interleaved document sequences of text and media.

An HTML page becomes an ordered array of segments, text or media reference,
each with its position; a reference carries its caption (the figure's, else the
alternative text).  Media bytes live in a store keyed by the SHA-256 digest of
their payload; a join on the digest resolves references and positions keep text
and media aligned.  Only digests and features go through the join, never
payloads.

Payloads are stored as 8-bit grey images (binary PGM, 24 samples wide), whose
samples are the payload's bytes; reading back checks them against the digest.
A reference may say how many of the payload's bytes count (``?bytes=``), which
the padded payload alone cannot tell.

Defined cases: null or empty HTML has no segments; an unclosed tag is closed by
its parent's end; a reference whose digest the store lacks stays, with null
features; repeated rows, rows with equal or null keys and repeated references
stay apart, as pages are numbered; equal payloads are stored once a task and
joined once; empty tables give no rows; columns other than those named are
ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandline.llm.workspace import Batches, Recent, Workspace, text_steps, worker

WIDTH = 24
#: A payload is a multiple of this: one frame of 24 x 24 samples.
UNIT = WIDTH * WIDTH
PAD = b"\xff"
REF = "media:sha256/"
SEGMENTS = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"
#: Bytes of payloads that a worker takes at a time.
_BATCH = 8_000_000

_BLOCK = set("address article aside blockquote body dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
_SILENT = {"script", "style", "template", "noscript", "head", "title"}
_MEDIA = {"img", "video", "audio", "source", "embed", "iframe"}
_SPACE = re.compile(r"\s+")


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self._text: list[str] = []
        self._silent: list[str] = []
        self._figures: list[tuple[int, list[str]]] = []  # first segment, caption text
        self._caption = 0

    def _add(self, **segment) -> None:
        self.out.append({"position": len(self.out), "kind": None, "text": None, "ref": None, "caption": None} | segment)

    def _cut(self) -> None:
        text = _SPACE.sub(" ", "".join(self._text)).strip()
        self._text.clear()
        if not text:
            return
        if self._caption and self._figures:
            self._figures[-1][1].append(text)
        else:
            self._add(kind="text", text=text)

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self._cut()
            self._silent.append(tag)
        elif tag in _MEDIA:
            at = dict(attrs)
            if at.get("src") and not self._silent:
                self._cut()
                self._add(kind="media", ref=at["src"], caption=at.get("alt") or at.get("title"))
        elif tag == "br":
            self._text.append(" ")
        elif tag in _BLOCK:
            self._cut()
            if tag == "figure":
                self._figures.append((len(self.out), []))
            elif tag == "figcaption":
                self._caption += 1
            elif tag == "body":
                self._silent.clear()  # an unclosed head ends here

    def handle_endtag(self, tag):
        if tag in self._silent:
            del self._silent[self._silent.index(tag) :]
            self._text.clear()
        elif tag in _BLOCK:
            self._cut()
            if tag == "figcaption":
                self._caption = max(0, self._caption - 1)
            elif tag == "figure" and self._figures:
                self._close_figure()

    def _close_figure(self) -> None:
        first, caption = self._figures.pop()
        if not caption:
            return
        media = [s for s in self.out[first:] if s["kind"] == "media"]
        for s in media:
            s["caption"] = " ".join(caption)
        if not media:  # a caption without media is text
            self._add(kind="text", text=" ".join(caption))

    def handle_data(self, data):
        if not self._silent:
            self._text.append(data)

    def read(self, html: str) -> list[dict]:
        self.feed(html)
        self.close()
        self._cut()
        while self._figures:
            self._close_figure()
        return self.out


def parse_html(html: str | None) -> list[dict]:
    """Segments of a page, in document order."""
    return _Reader().read(html) if html else []


def parse_pages(pages: DataFrame, key: str = "page_id", html: str = "html", keep_text: bool = True) -> DataFrame:
    """``key``, ``page`` (a number of its own for every row) and ``segments``.
    Without ``keep_text`` the segments' texts are null, their places stay."""
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    @worker
    def run(batches: Batches) -> Batches:
        first = TaskContext.get().partitionId() << 33
        for b in text_steps(batches, 1):
            found = [parse_html(h) for h in b.column(1).to_pylist()]
            if not keep_text:
                for s in (s for f in found for s in f):
                    s["text"] = None
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.arange(first, first + b.num_rows)), pa.array(found, kind)], names=[key, "page", "segments"])
            first += b.num_rows

    rows = pages.select(F.col(key), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(run, StructType([rows.schema[0], *StructType.fromDDL(f"page long, segments {SEGMENTS}")]))


def references(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """One row a media reference: key, page, position, ref, digest (null if the
    reference does not name one), n_bytes (null if it does not say) and caption."""
    s = parsed.select(F.col(key), "page", F.explode("segments").alias("s")).filter("s.kind = 'media'")
    return s.select(key, "page", "s.position", "s.ref", _said_digest(F.col("s.ref")).alias("digest"), _said_bytes(F.col("s.ref")).alias("n_bytes"), "s.caption")


def _said_digest(ref: Column) -> Column:
    return F.when(ref.startswith(REF), F.lower(F.substring_index(F.substring(ref, len(REF) + 1, 1000), "?", 1)))


def _said_bytes(ref: Column) -> Column:
    return F.nullif(F.regexp_extract(ref, r"\?bytes=(\d+)$", 1), F.lit("")).cast("long")


def resolve(parsed: DataFrame, facts: DataFrame, space: Workspace, key: str = "page_id") -> DataFrame:
    """``key`` and segments with the store's ``facts`` (one row a digest) in the
    place of their reference: an array of (position, kind, text, ref, caption,
    media), aligned by position."""
    parsed = space.save(parsed, "parsed")  # pages keep their numbers
    known = facts.select("digest", F.struct(*[F.col(f"`{c}`") for c in facts.columns if c != "digest"]).alias("media"))
    asked = references(parsed, key).select("page", "position", "digest").filter("digest is not null")
    found = asked.join(known, "digest").groupBy("page").agg(F.collect_list(F.struct("position", "media")).alias("media"))
    at = lambda s: F.get(F.filter(F.col("media"), lambda m: m["position"] == s["position"]), F.lit(0))["media"]
    aligned = F.transform("segments", lambda s: F.struct(*[s[c].alias(c) for c in ("position", "kind", "text", "ref", "caption")], at(s).alias("media")))
    return parsed.join(found, "page", "left").select(key, aligned.alias("segments"))


def pad(raw: bytes) -> bytes:
    """A payload: the bytes, filled up to a positive multiple of the unit."""
    return raw + PAD * (-len(raw) % UNIT if raw else UNIT)


def to_image(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def from_image(image: bytes) -> bytes:
    """The samples of a stored image; a damaged header or length is an error."""
    head = re.match(rb"P5\n(\d+) (\d+)\n255\n", image)
    if not head or len(image) - head.end() != int(head[1]) * int(head[2]):
        raise ValueError("not a stored image")
    return image[head.end() :]


def image_feature(payload: bytes) -> str:
    """Grey-level histogram of 16 bins and an 8 x 8 average hash of the mean frame."""
    a = np.frombuffer(payload, np.uint8)
    hist = np.bincount(a >> 4, minlength=16)
    frame = a.reshape(-1, UNIT).sum(axis=0, dtype=np.int64).reshape(8, 3, 8, 3).sum(axis=(1, 3)).ravel()
    bits = "".join("1" if x else "0" for x in frame * 64 > frame.sum())
    return f"ahash:{int(bits, 2):016x};hist:" + ",".join(map(str, hist.tolist()))


def store_texts(docs: DataFrame, space: Workspace) -> DataFrame:
    """Writes every text's payload and its first frame once a task; returns the
    table (digest, media)."""

    @worker
    def run(batches: Batches) -> Batches:
        seen = Recent()
        for b in text_steps(batches, 0, _BATCH):
            digests, images = [], []
            for raw in b.column(0):
                payload = pad(raw.as_py() or b"")
                for media in (payload, payload[:UNIT]):
                    digest = hashlib.sha256(media)
                    if seen.new(digest.digest()):
                        digests.append(digest.hexdigest())
                        images.append(to_image(media))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(images, pa.binary())], names=["digest", "media"])

    return space.save(docs.select(F.col("text").cast("binary").alias("raw")).mapInArrow(run, "digest string, media binary"), "media")


FACTS = "digest string, payload_bytes long, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(store: DataFrame) -> DataFrame:
    """Decodes every stored image, checks it against its digest, and describes it;
    one row a digest, which is that of the payload as read."""
    names = [c.split(" ")[0] for c in FACTS.split(", ")]
    schema = pa.schema([(c, pa.int64() if k == "long" else pa.string()) for c, k in (x.split(" ") for x in FACTS.split(", "))])

    @worker
    def run(batches: Batches) -> Batches:
        for b in text_steps(batches, 1, _BATCH):
            rows = []
            for digest, image in zip(b.column(0).to_pylist(), b.column(1)):
                image = image.as_py()
                payload = from_image(image)
                sha = hashlib.sha256(payload).hexdigest()
                if sha != digest:
                    raise ValueError(f"stored media {digest} does not match its digest")
                rows.append((sha, len(payload), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), image_feature(payload)))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)

    return store.select("digest", "media").mapInArrow(run, FACTS).dropDuplicates(["digest"])


def text_pages(docs: DataFrame) -> DataFrame:
    """A page for every document: its first frame as a figure with an alternative
    text, then its paragraphs, and among them, at a place that the text decides, a
    figure with a caption that refers to the document's whole payload."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    fill = F.when(F.length(raw) == 0, F.lit(UNIT)).otherwise(F.pmod(-F.length(raw), F.lit(UNIT)))
    payload = F.concat(raw, F.unhex(F.repeat(F.lit("ff"), fill)))
    escaped = lambda t: F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda t: F.trim(t) != "")
    rows = docs.select("doc_id", F.length(raw).alias("__n"), F.sha2(payload, 256).alias("__whole"), F.sha2(F.substring(payload, 1, UNIT), 256).alias("__frame"), F.transform(lines, lambda t: F.concat(F.lit("<p>"), escaped(t), F.lit("</p>"))).alias("__p"), F.xxhash64("text").alias("__h"))
    rows = rows.withColumn("__at", F.pmod("__h", F.size("__p") + 1).cast("int"))
    preview = F.concat(F.lit('<figure><img alt="First frame" src="' + REF), F.col("__frame"), F.lit('"></figure>'))
    caption = F.concat(F.lit("After paragraph "), F.col("__at"), F.lit(" of "), F.size("__p"))
    figure = F.concat(F.lit('<figure><img alt="Whole text" src="' + REF), F.col("__whole"), F.lit("?bytes="), F.col("__n"), F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure>"))
    before, after = F.slice("__p", F.lit(1), F.col("__at")), F.slice("__p", F.col("__at") + 1, F.size("__p"))
    body = F.array_join(F.concat(F.array(preview), before, F.array(figure), after), "")
    return rows.select("doc_id", F.concat(F.lit("<article>"), body, F.lit("</article>")).alias("html"))


def document_media(docs: DataFrame) -> DataFrame:
    """Stores, references, resolves and describes the payload of every document.

    doc_id, n_bytes (said by the reference), the facts of the whole payload, its
    position and caption in the document's sequence, and how many texts and how
    many resolved media that sequence has."""
    space = Workspace(docs.sparkSession, "media")
    facts = space.save(read_back(store_texts(docs, space)), "facts")
    pages = resolve(parse_pages(text_pages(docs), "doc_id", keep_text=False), facts, space, "doc_id")
    count = lambda keep: F.size(F.filter("segments", keep)).cast("long")
    whole = F.get(F.filter("segments", lambda s: _said_bytes(s["ref"]).isNotNull()), F.lit(0))
    rows = pages.select("doc_id", whole.alias("m"), count(lambda s: s["kind"] == "text").alias("n_texts"), count(lambda s: s["media"].isNotNull()).alias("n_media"))
    # media were found by their digest, so it need not travel with them
    digest = F.when(F.col("m.media").isNotNull(), _said_digest(F.col("m.ref"))).alias("payload_sha256")
    return rows.select("doc_id", _said_bytes(F.col("m.ref")).alias("n_bytes"), digest, "m.media.*", F.col("m.position").alias("position"), F.col("m.caption").alias("caption"), "n_texts", "n_media")


def page_sequences(pages: DataFrame) -> DataFrame:
    """``(page_id, url, n_texts, n_media, n_chars, first, last)``: what the sequence of
    every page holds, with its first and last text."""
    parsed = parse_pages(pages.select(F.struct("page_id", "url").alias("key"), "html"), "key")
    texts = F.filter("segments", lambda s: s["kind"] == "text")
    chars = F.aggregate("texts", F.lit(0).cast("long"), lambda a, s: a + F.length(s["text"]))
    rows = parsed.select("key.*", F.size("segments").alias("n"), texts.alias("texts"))
    ends = [F.get(F.col("texts"), at)["text"].alias(name) for name, at in (("first", F.lit(0)), ("last", F.size("texts") - 1))]
    return rows.select("page_id", "url", F.size("texts").cast("long").alias("n_texts"), (F.col("n") - F.size("texts")).cast("long").alias("n_media"), chars.alias("n_chars"), *ends)
