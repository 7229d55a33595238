"""EXIF tags out of the bytes of a picture: JPEG, PNG and TIFF.

The block is found by the container's own marks, then the directories of its TIFF
structure are walked: the first, and those for the camera, for positions and for
interchange, to which it points. Whatever does not hold to the structure ends the walk;
what was read before it stays.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

# Names of tags by number, and sizes of the types of values.
TAGS = {
    256: "ImageWidth", 257: "ImageLength", 270: "ImageDescription", 271: "Make", 272: "Model", 274: "Orientation", 282: "XResolution", 283: "YResolution",
    296: "ResolutionUnit", 305: "Software", 306: "DateTime", 315: "Artist", 33432: "Copyright", 33434: "ExposureTime", 33437: "FNumber", 34665: "ExifOffset",
    34850: "ExposureProgram", 34853: "GPSInfo", 34855: "ISOSpeedRatings", 36864: "ExifVersion", 36867: "DateTimeOriginal", 36868: "DateTimeDigitized",
    36880: "OffsetTime", 36881: "OffsetTimeOriginal", 36882: "OffsetTimeDigitized", 37377: "ShutterSpeedValue", 37378: "ApertureValue",
    37379: "BrightnessValue", 37380: "ExposureBiasValue", 37381: "MaxApertureValue", 37382: "SubjectDistance", 37383: "MeteringMode", 37384: "LightSource",
    37385: "Flash", 37386: "FocalLength", 37520: "SubsecTime", 37521: "SubsecTimeOriginal", 37522: "SubsecTimeDigitized", 40961: "ColorSpace",
    40962: "ExifImageWidth", 40963: "ExifImageHeight", 41986: "ExposureMode", 41987: "WhiteBalance", 41988: "DigitalZoomRatio",
    41989: "FocalLengthIn35mmFilm", 41990: "SceneCaptureType", 42033: "BodySerialNumber", 42036: "LensModel",
}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
_POINTERS = (34665, 34853, 40965)


def exif_block(data: bytes) -> bytes | None:
    """The TIFF structure with the tags of a JPEG, PNG or TIFF file; None if there is none."""
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if mark == 0xFF:  # filling
                at += 1
                continue
            if mark == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + size]
            if mark == 0xDA or size < 2:  # the picture itself begins
                return None
            at += 2 + size
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size = int.from_bytes(data[at : at + 4], "big")
            if data[at + 4 : at + 8] == b"eXIf":
                return data[at + 8 : at + 8 + size]
            at += 12 + size
    elif data[:4] in (b"II*\0", b"MM\0*"):
        return data
    return None


def _value(block: bytes, order: str, kind: int, count: int, at: int) -> str | None:
    size = _SIZES[kind] * count
    if size > 4:
        at = struct.unpack_from(order + "I", block, at)[0]
    raw = block[at : at + size]
    if len(raw) < size:
        return None
    if kind == 2:
        return raw.split(b"\0")[0].decode("utf-8", "replace")
    if kind == 7:
        return raw.rstrip(b"\0").decode("ascii") if raw.rstrip(b"\0").isascii() else raw.hex()
    if kind in (5, 10):
        numbers = struct.unpack(order + ("II" if kind == 5 else "ii") * count, raw)
        return ", ".join(f"{a}/{b}" for a, b in zip(numbers[::2], numbers[1::2]))
    return ", ".join(map(str, struct.unpack(f"{order}{count}{_CODES[kind]}", raw)))


def tags(data: bytes | None) -> dict[str, str]:
    """Tag name, or number if it has no name, to its value as text; fractions as a/b, several values with commas. Empty if nothing can be read."""
    out: dict[str, str] = {}
    block = exif_block(data) if data else None
    if not block or block[:2] not in (b"II", b"MM"):
        return out
    order = "<" if block[:2] == b"II" else ">"
    try:
        todo, seen = [struct.unpack_from(order + "I", block, 4)[0]], set()
        while todo:
            at = todo.pop(0)
            if at in seen:
                continue
            seen.add(at)
            for i in range(struct.unpack_from(order + "H", block, at)[0]):
                tag, kind, count = struct.unpack_from(order + "HHI", block, at + 2 + 12 * i)
                if tag in _POINTERS:
                    todo.append(struct.unpack_from(order + "I", block, at + 10 + 12 * i)[0])
                elif kind in _SIZES and (value := _value(block, order, kind, count, at + 10 + 12 * i)) is not None:
                    out.setdefault(TAGS.get(tag, str(tag)), value)
    except struct.error:  # the file ends before the structure does
        pass
    return out


@F.pandas_udf(MapType(StringType(), StringType()))
def _tags(files: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for f in files:
        yield f.map(lambda x: tags(bytes(x)) if x is not None else {})


def exif_tags(content: Column) -> Column:
    """The tags of each file's bytes as a map; an empty map for null and for files without tags."""
    return _tags(content)
