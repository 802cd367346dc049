"""Types of files by their first bytes, as Columns over binary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# First bytes and types, in the order in which they are tried; members that tell kinds of ZIP files apart;
# beginnings of markup; endings of texts; types that are accepted.
SIGNATURES = (
    (b"\x89PNG\r\n\x1a\n", "image/png"),
    (b"\xff\xd8\xff", "image/jpeg"),
    (b"%PDF-", "application/pdf"),
    (b"II*\x00", "image/tiff"),
    (b"MM\x00*", "image/tiff"),
    (b"\x7fELF", "application/x-elf"),
    (b"MZ", "application/x-dosexec"),
    (b"\xca\xfe\xba\xbe", "application/x-mach-binary"),
    (b"Rar!\x1a\x07\x00", "application/x-rar"),
    (b"7z\xbc\xaf\x27\x1c", "application/x-7z-compressed"),
    (b"\x1f\x8b", "application/gzip"),
    (b"BZh", "application/x-bzip2"),
)
ZIP = b"PK\x03\x04"
OFFICE = "application/vnd.openxmlformats-officedocument."
MEMBERS = ((b"word/", OFFICE + "wordprocessingml.document"), (b"xl/", OFFICE + "spreadsheetml.sheet"), (b"ppt/", OFFICE + "presentationml.presentation"))
MARKUP = ("<!doctype html", "<html", "<head", "<body", "<?xml")
ENDINGS = {"text/markdown": ("md", "markdown", "mdown", "mkd"), "text/html": ("html", "htm", "xhtml")}
ALLOWED = ("application/pdf", OFFICE + "wordprocessingml.document", OFFICE + "presentationml.presentation", OFFICE + "spreadsheetml.sheet", "text/plain", "text/markdown", "text/html", "image/png", "image/jpeg", "image/tiff")
#: Bytes that are looked at, those of markup's beginning, and the share of control characters from which it isn't text.
WINDOW, BEGINNING, CONTROLS = 4096, 256, 0.05


def is_text(head: Column, size: int = WINDOW) -> Column:
    """Whether the window is UTF-8 without NUL and with few control characters; false for null and empty."""
    window = F.substring(head, 1, size)
    text = F.try_validate_utf8(window.cast("string"))
    controls = F.char_length(text) - F.char_length(F.regexp_replace(text, r"[\x00-\x08\x0B\x0E-\x1F]", ""))
    return F.coalesce((F.char_length(text) > 0) & ~F.contains(text, F.lit("\x00")) & (controls < CONTROLS * F.char_length(text)), F.lit(False))


def detect_mime(head: Column, name: Column) -> Column:
    """The type by signature, then by members of a ZIP file, then as text by its beginning and the name's ending; null for
    empty content, application/zip or application/octet-stream where nothing else fits.

    A window that ends inside a character isn't verified as text, so no name counts; a beginning of markup does.
    """
    start = F.lower(F.regexp_replace(F.substring(head, 1, BEGINNING).cast("string"), r"^[ \t\n\r\x0B\f]+", ""))
    ending = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    out = F.when(head.isNull() | (F.octet_length(head) == 0), F.lit(None).cast("string"))
    for magic, mime in SIGNATURES:
        out = out.when(F.startswith(head, F.lit(bytearray(magic))), mime)
    zipped = F.startswith(head, F.lit(bytearray(ZIP)))
    for member, mime in MEMBERS:
        out = out.when(zipped & F.contains(head, F.lit(bytearray(member))), mime)
    marked = reduce(lambda a, b: a | b, (F.startswith(start, F.lit(x)) for x in MARKUP))
    cut = reduce(lambda a, b: a | b, (is_text(head, WINDOW - k) for k in (1, 2, 3)))  # without the character that the window cuts
    out = out.when(zipped, "application/zip").when(marked & (is_text(head) | cut), "text/html").when(~is_text(head), "application/octet-stream")
    for mime, endings in ENDINGS.items():
        out = out.when(ending.isin(*endings), mime)
    return out.otherwise("text/plain")


def accepted(mime: Column, allowed: tuple[str, ...] = ALLOWED) -> Column:
    return F.coalesce(mime.isin(*allowed), F.lit(False))
