"""Interleaved document sequences: ordered text and media references from HTML, with payloads joined by digest.

Payloads are stored as binary greymaps of 24 samples a row in a content-addressed table, and what is known of a stored
payload is read back from its stored bytes. Positions and captions stay with their references throughout.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import bound_batches, materialize, table

SIDE = 24
FRAME = SIDE * SIDE
ITEMS = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
SKIP = frozenset({"script", "style", "noscript", "template"})
MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "video"}
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strong sub sup time tt u var wbr".split())


def parse(html: str | None) -> list[dict]:
    """Text and media items in the order of the page.

    A block element ends a text item; white space collapses and blank items are left out. The caption of a media item is
    the figcaption of its figure, else its alt text, else null. Scripts, styles and comments have no items; null has none.
    """
    items: list[dict] = []
    text: list[str] = []
    skipping = ""
    caption: list[str] | None = None
    figure: int | None = None

    def flush():
        said = " ".join(unescape("".join(text)).split())
        text.clear()
        if said:
            items.append({"position": len(items), "kind": "text", "text": said, "ref": None, "caption": None})

    for m in TOKEN.finditer(html or ""):
        closing, tag, attrs, chars = m.groups()
        if chars is not None:
            if not skipping:
                (text if caption is None else caption).append(chars)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if skipping:
            if closing and tag == skipping:
                skipping = ""
        elif tag in SKIP:
            if not closing:
                skipping = tag
        elif tag in MEDIA and not closing:
            found = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(attrs)}
            ref = unescape(found.get("src", "")).strip()
            if ref:
                flush()
                alt = " ".join(unescape(found.get("alt", "")).split())
                items.append({"position": len(items), "kind": MEDIA[tag], "text": None, "ref": ref, "caption": alt or None})
        elif tag == "figure":
            flush()
            figure = None if closing else len(items)
        elif tag == "figcaption":
            flush()
            if not closing:
                caption = []
            elif caption is not None:
                said = " ".join(unescape("".join(caption)).split())
                own = items[figure:] if figure is not None else []
                held = [x for x in own if x["kind"] != "text"]
                for x in held:
                    x["caption"] = said or x["caption"]
                if said and not held:  # a caption of nothing is text
                    items.append({"position": len(items), "kind": "text", "text": said, "ref": None, "caption": None})
                caption = None
        elif tag not in INLINE:
            (text if caption is None else caption).append(" ")
            if caption is None:
                flush()
    if caption:
        text += caption
    flush()
    return items


def sequences(pages: DataFrame) -> DataFrame:
    """(page_id, items) of every row of pages(page_id, html); items as ``parse`` gives them, none for a null page."""

    @F.pandas_udf(ITEMS)
    def items(html: pd.Series) -> pd.Series:
        return pd.Series([parse(h) for h in html])

    return pages.select("page_id", items(F.col("html").cast("string")).alias("items"))


def payload_of(text: Column) -> Column:
    """UTF-8 bytes of text (null: none) and bytes 255 up to a positive multiple of FRAME."""
    data = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    size = F.greatest(F.ceil(F.octet_length(data) / FRAME), F.lit(1)) * FRAME
    return F.rpad(data, size.cast("int"), F.lit(b"\xff"))


def stored_form(payload: Column) -> Column:
    """A binary greymap of the payload's bytes as 8-bit samples, SIDE to a row."""
    rows = (F.octet_length(payload) / SIDE).cast("int").cast("string")
    return F.concat(F.concat(F.lit(f"P5\n{SIDE} "), rows, F.lit("\n255\n")).cast("binary"), payload)


def read_back(media: bytes) -> bytes:
    """The samples of a stored greymap."""
    head = re.match(rb"P5\s+(\d+)\s+(\d+)\s+255\s", media)
    if head is None or len(media) - head.end() != int(head[1]) * int(head[2]):
        raise ValueError("not a greymap of 8-bit samples")
    return media[head.end() :]


def features_of(payload: bytes) -> str:
    """Average hash of the mean frame: 64 bits, whether each 3 x 3 block lies above the mean; then the mean sample."""
    frames = np.frombuffer(payload, np.uint8).reshape(-1, FRAME)
    mean = frames.mean(0).reshape(SIDE // 3, 3, SIDE // 3, 3).mean((1, 3)).ravel()
    return f"{np.packbits(mean > mean.mean()).tobytes().hex()}:{frames.mean():.3f}"


def described(store: DataFrame) -> DataFrame:
    """What the stored bytes of store(digest, media) hold, one row for each digest however often it is stored."""
    shape = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    @F.pandas_udf(shape)
    def read(media: pd.Series) -> pd.DataFrame:
        out = []
        for m in media:
            p = read_back(m)  # byte 255 is in no UTF-8 text, so the padding can be told from it
            out.append((len(p.rstrip(b"\xff")), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), features_of(p)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in shape.split(", ")])

    return store.select("digest", read("media").alias("d")).groupBy("digest").agg(F.first("d").alias("d")).select("digest", "d.*")


def resolve(pages: DataFrame, known: DataFrame) -> DataFrame:
    """One row for each media item of pages(page_id, items): page_id, n_items, position, caption, ref and the columns of
    known(digest, ...), which are null where the reference is no stored digest.

    The join is on (ref = digest); a reference that very many pages share is split by adaptive execution, as both sides
    are dealt out for the join alone.
    """
    rows = pages.select("page_id", F.size("items").alias("n_items"), F.explode("items").alias("i")).where("i.kind <> 'text'")
    refs = rows.select("page_id", "n_items", "i.position", "i.caption", F.regexp_replace("i.ref", "^sha256:", "").alias("ref"))
    return refs.join(known, refs["ref"] == known["digest"], "left").drop("digest")


def page_of(text: Column, digest: Column) -> Column:
    """A page with a paragraph for each line of text and a figure that refers to the payload, captioned by the first line."""
    clean = F.replace(F.replace(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.concat(F.lit("<article><p>"), F.replace(clean, F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
    caption = F.concat(F.lit("<figcaption>"), F.substring_index(clean, "\n", 1), F.lit("</figcaption></figure></article>"))
    return F.concat(body, F.lit('<figure><img src="sha256:'), digest, F.lit('">'), caption)


def document_media(docs: DataFrame) -> DataFrame:
    """One row for every row of docs(doc_id, text): the media item of its page, resolved from the stored payload.

    Null and empty texts have a payload of padding alone. Equal texts share one digest and so all values but doc_id.
    Rows with a null or a repeated doc_id stay. Other columns are ignored; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    payload = payload_of(F.col("text"))
    store = materialize(docs.select(F.sha2(payload, 256).alias("digest"), stored_form(payload).alias("media")), "media", "zstd")
    known = materialize(described(store), "described")
    pages = docs.select(F.col("doc_id").alias("page_id"), page_of(F.col("text"), F.sha2(payload, 256)).alias("html"))
    found = resolve(sequences(pages), known).withColumnRenamed("page_id", "doc_id")
    first = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return found.select(*first, "n_items", "position", "caption")


def op2_media(spark, sf_dir: str) -> DataFrame:
    return document_media(table(spark, sf_dir, "documents"))
