"""Image and PDF functions on binary columns.

Formats and sizes are read from the bytes by themselves; decoding needs Pillow or pypdf, which may be absent.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewright.errors import EngineError

# Limits of the media functions.
MAX_BYTES, MAX_BATCH_BYTES, MAX_PIXELS, MAX_PAGES, MAX_DOCUMENT_PAGES, MAX_DPI = 256 << 20, 512 << 20, 64_000_000, 100, 10_000, 600
NAMES = frozenset({"IMAGE_WIDTH", "IMAGE_HEIGHT", "IMAGE_FORMAT", "IMAGE_RESIZE", "PDF_PAGE_COUNT", "PDF_SPLIT", "PDF_RENDER_PAGE", "PDF_TO_IMAGES"})


def _checked(data: bytes | None) -> bytes | None:
    if data is not None and len(data) > MAX_BYTES:
        raise EngineError("the media value is too large")
    return None if data is None else bytes(data)


def image_format(data: bytes | None) -> str | None:
    """The format by its first bytes."""
    data = _checked(data)
    if not data:
        return None
    starts = ((b"\x89PNG\r\n\x1a\n", "PNG"), (b"\xff\xd8\xff", "JPEG"), (b"GIF8", "GIF"), (b"BM", "BMP"), (b"II*\0", "TIFF"), (b"MM\0*", "TIFF"), (b"\0\0\1\0", "ICO"), (b"\0\0\0\x0cjP", "JPEG2000"), (b"\xff\x0a", "JXL"))
    for start, name in starts:
        if data.startswith(start):
            return name
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "WEBP"
    if data[4:8] == b"ftyp":
        return "AVIF" if data[8:12] in (b"avif", b"avis") else "HEIF"
    if re.match(rb"P[1-6]\s", data):
        return "PPM"
    raise EngineError("the bytes are no known image format")


def image_size(data: bytes | None) -> tuple[int, int] | None:
    """(width, height) from the header of PNG, GIF, BMP, WebP (VP8X) and JPEG."""
    kind = image_format(data)
    if kind is None:
        return None
    if kind == "PNG":
        return struct.unpack(">II", data[16:24])
    if kind == "GIF":
        return struct.unpack("<HH", data[6:10])
    if kind == "BMP":
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    if kind == "JPEG":
        at, turned, size = 2, False, None
        while at + 9 < len(data):
            marker, length = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                turned = _exif_orientation(data[at + 10 : at + 2 + length]) >= 5
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                size = (h, w) if turned else (w, h)
                break
            at += 2 + length
        if size:
            return size
    return _pillow(lambda image: image.size)(data)


def _exif_orientation(tiff: bytes) -> int:
    order = "<" if tiff[:2] == b"II" else ">"
    at = struct.unpack(order + "I", tiff[4:8])[0]
    for k in range(struct.unpack(order + "H", tiff[at : at + 2])[0]):
        entry = tiff[at + 2 + 12 * k : at + 14 + 12 * k]
        if struct.unpack(order + "H", entry[:2])[0] == 0x0112:
            return struct.unpack(order + "H", entry[8:10])[0]
    return 1


def _pillow(work: Callable) -> Callable[[bytes | None], object]:
    def run(data: bytes | None) -> object:
        try:
            import io

            from PIL import Image, ImageOps
        except ImportError as e:
            raise EngineError("this image function needs Pillow on every worker") from e
        if data is None:
            return None
        Image.MAX_IMAGE_PIXELS = MAX_PIXELS
        return work(ImageOps.exif_transpose(Image.open(io.BytesIO(_checked(data)))))

    return run


def image_resize(data: bytes | None, width: int, height: int, fit: str = "contain", kind: str = "PNG", quality: int = 85) -> bytes | None:
    if fit not in ("contain", "cover", "stretch"):
        raise EngineError(f"unknown fit {fit!r}")
    if width < 1 or height < 1 or width * height > MAX_PIXELS:
        raise EngineError("the size is out of range")

    def work(image) -> bytes:
        import io

        from PIL import ImageOps

        out = image.resize((width, height)) if fit == "stretch" else ImageOps.fit(image, (width, height)) if fit == "cover" else ImageOps.contain(image, (width, height))
        buffer = io.BytesIO()
        out.convert("RGB" if kind.upper() == "JPEG" else out.mode).save(buffer, kind, quality=quality)
        return buffer.getvalue()

    return _pillow(work)(data)


def _reader(data: bytes):
    try:
        import io

        from pypdf import PdfReader
    except ImportError as e:
        raise EngineError("PDF functions need pypdf on every worker") from e
    reader = PdfReader(io.BytesIO(_checked(data)))
    if len(reader.pages) > MAX_DOCUMENT_PAGES:
        raise EngineError("the document has too many pages")
    return reader


def pdf_page_count(data: bytes | None) -> int | None:
    return None if data is None else len(_reader(data).pages)


def page_range(total: int, start: int | None, end: int | None) -> range:
    """1-based, both ends included."""
    first, last = start or 1, total if end is None else end
    if first < 1 or last < first or last > total or last - first + 1 > MAX_PAGES:
        raise EngineError("the page range is out of bounds")
    return range(first - 1, last)


def pdf_split(data: bytes | None, start: int | None = None, end: int | None = None) -> list[bytes] | None:
    if data is None:
        return None
    import io

    reader = _reader(data)
    from pypdf import PdfWriter

    out = []
    for i in page_range(len(reader.pages), start, end):
        writer = PdfWriter()
        writer.add_page(reader.pages[i])
        buffer = io.BytesIO()
        writer.write(buffer)
        out.append(buffer.getvalue())
    return out


def pdf_render_page(data: bytes | None, page: int, dpi: int = 144) -> bytes | None:
    if data is None:
        return None
    if not 1 <= dpi <= MAX_DPI:
        raise EngineError("the resolution is out of range")
    try:
        import io

        import pypdfium2
    except ImportError as e:
        raise EngineError("rendering needs pypdfium2 on every worker") from e
    buffer = io.BytesIO()
    pypdfium2.PdfDocument(data)[page - 1].render(scale=dpi / 72).to_pil().save(buffer, "PNG")
    return buffer.getvalue()


def pdf_to_images(data: bytes | None, dpi: int = 144, start: int | None = None, end: int | None = None) -> list[bytes] | None:
    return None if data is None else [pdf_render_page(data, i + 1, dpi) for i in page_range(pdf_page_count(data), start, end)]


_SIGNATURES = {
    "image_width": (lambda d: (s := image_size(d)) and s[0], "int"),
    "image_height": (lambda d: (s := image_size(d)) and s[1], "int"),
    "image_format": (image_format, "string"),
    "image_resize": (image_resize, "binary"),
    "pdf_page_count": (pdf_page_count, "int"),
    "pdf_split": (pdf_split, "array<binary>"),
    "pdf_render_page": (pdf_render_page, "binary"),
    "pdf_to_images": (pdf_to_images, "array<binary>"),
}


def register(spark: SparkSession) -> None:
    """Makes all media functions callable in SQL, on Arrow batches."""
    for name, (fn, kind) in _SIGNATURES.items():

        def run(*columns: pd.Series, fn: Callable = fn) -> pd.Series:
            if sum(len(d) for d in columns[0] if d is not None) > MAX_BATCH_BYTES:
                raise EngineError("the media values of a batch are too large")
            return pd.Series([fn(*(v.item() if hasattr(v, "item") else v for v in r)) for r in zip(*columns, strict=True)], dtype="object")

        spark.udf.register(name, F.pandas_udf(run, kind, F.PandasUDFType.SCALAR))
