"""File kinds by extension."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension -> MIME type.
MIME_TYPES = {
    ".txt": "text/plain",
    ".md": "text/markdown",
    ".html": "text/html",
    ".htm": "text/html",
    ".css": "text/css",
    ".js": "application/javascript",
    ".json": "application/json",
    ".xml": "application/xml",
    ".pdf": "application/pdf",
    ".zip": "application/zip",
    ".tar": "application/x-tar",
    ".gz": "application/gzip",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".gif": "image/gif",
    ".bmp": "image/bmp",
    ".svg": "image/svg+xml",
    ".webp": "image/webp",
    ".mp3": "audio/mpeg",
    ".wav": "audio/wav",
    ".flac": "audio/flac",
    ".ogg": "audio/ogg",
    ".mp4": "video/mp4",
    ".avi": "video/x-msvideo",
    ".mkv": "video/x-matroska",
    ".webm": "video/webm",
    ".mov": "video/quicktime",
}
UNKNOWN_MIME = "application/octet-stream"

# Image formats looked for by default.
IMAGE_FORMATS = ("jpg", "jpeg", "png", "gif", "bmp", "tiff")


def mime_type(ext: Column) -> Column:
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(MIME_TYPES.items())])
    return F.coalesce(F.try_element_at(table, ext), F.lit(UNKNOWN_MIME))


def mime_is(mime: Column, family: str) -> Column:
    return F.startswith(mime, F.lit(family + "/"))


def category(mime: Column) -> Column:
    """Coarse group of a MIME type; plain text and PDF are documents."""
    packed = mime.rlike("zip|tar")
    return (
        F.when(mime_is(mime, "image"), "images")
        .when(mime_is(mime, "video"), "videos")
        .when(mime_is(mime, "audio"), "audio")
        .when(mime_is(mime, "text") | (mime == "application/pdf"), "documents")
        .when(packed, "archives")
        .otherwise("other")
    )
