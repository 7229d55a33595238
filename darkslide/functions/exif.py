"""Numbers and names out of EXIF values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a missing or unreadable number is taken for.
DEFAULTS = {
    "ISOSpeedRatings": 400.0, "FNumber": 2.8, "ExposureTime": 0.001, "Flash": 0.0, "FocalLength": 50.0,
    "DigitalZoomRatio": 1.0, "ExposureBiasValue": 0.0, "WhiteBalance": 0.0, "ExposureMode": 0.0, "MeteringMode": 5.0,
}


# The columns that the numbers become.
NUMBERS = {
    "ISOSpeedRatings": "iso", "FNumber": "aperture", "ExposureTime": "shutter_speed", "Flash": "flash", "FocalLength": "focal_length",
    "DigitalZoomRatio": "digital_zoom", "ExposureBiasValue": "exposure_bias", "WhiteBalance": "white_balance", "ExposureMode": "exposure_mode", "MeteringMode": "metering_mode",
}


def value(tag: str, exif: str = "exif") -> Column:
    return F.try_element_at(exif, F.lit(tag))


def number(tag: str, exif: str = "exif") -> Column:
    """A plain number or a fraction such as 28/10; the tag's default if it is neither or divides by zero."""
    v = F.trim(value(tag, exif))
    over = F.split(v, "/")
    fraction = F.when(F.size(over) == 2, F.try_divide(over[0].try_cast("double"), over[1].try_cast("double")))
    return F.coalesce(fraction, v.try_cast("double"), F.lit(DEFAULTS[tag]))


def flash_fired(exif: str = "exif") -> Column:
    """Bit 0 of the flash value: 1 if it fired."""
    return number("Flash", exif).cast("bigint").bitwiseAND(F.lit(1)).cast("int")


def camera_id() -> Column:
    """Make, model and serial number; ``unknown`` without make or model."""
    make, model, serial = (F.nullif(F.trim(value(t)), F.lit("")) for t in ("Make", "Model", "BodySerialNumber"))
    return F.when(make.isNotNull() & model.isNotNull(), F.concat_ws(" ", make, model, serial)).otherwise("unknown")


def capture_time() -> Column:
    """Timestamp without a zone of the first of the four usual tags that is not empty, in the standard notation; else null."""
    raw = F.coalesce(*[F.nullif(F.trim(value(t)), F.lit("")) for t in ("DateTimeOriginal", "36867", "DateTime", "306")])
    return F.when(raw.rlike(r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$"), F.try_to_timestamp(raw, F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz"))


def golden_hour(hour: Column, warmth: Column) -> Column:
    """Light near sunrise and sunset, by hour and colour temperature, from 0 to 1."""
    w = F.greatest(F.lit(0.0), warmth / 50)
    low_sun = hour.between(6, 8) | hour.between(18, 20)
    return F.least(F.lit(1.0), F.when(low_sun, 0.5 + 0.5 * w).otherwise(0.2 * w))


def colour_temperature(r: Column, g: Column, b: Column) -> Column:
    total = r + g + b
    return F.when(total > 0, (r - b) / total * 100).otherwise(0.0)


def entropy(p: Column) -> Column:
    """Bits of uncertainty of a probability kept off 0 and 1; 1 if it is missing."""
    q = F.when(p.isNotNull() & ~F.isnan(p), F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), p)))
    return F.coalesce(-(q * F.log2(q) + (1 - q) * F.log2(1 - q)), F.lit(1.0))
