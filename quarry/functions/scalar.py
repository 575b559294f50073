"""Scalar expressions used by reports, planners and selection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that a file system reserves.
RESERVED = ("con", "prn", "aux", "nul", *[f"com{k}" for k in range(1, 10)], *[f"lpt{k}" for k in range(1, 10)])


def human_size(n: Column) -> Column:
    """Bytes in the largest unit that leaves one or more, one decimal from KiB on."""
    out = F.format_string("%d B", n.cast("long"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**power, F.format_string(f"%.1f {unit}", n / F.lit(float(1024**power)))).otherwise(out)
    return out


def safe_name(name: Column, most: int = 80) -> Column:
    """A name fit for a folder: marks to underscores, at most ``most`` characters, reserved names prefixed."""
    clean = F.rtrim(F.regexp_replace(name, r'[\\/:*?"<>|\x00-\x1f]', "_"))
    clean = F.regexp_replace(F.substring(clean, 1, most), r"[. ]+$", "")
    clean = F.when(clean == "", "_").otherwise(clean)
    return F.when(F.lower(clean).isin(*RESERVED), F.concat(F.lit("_"), clean)).otherwise(clean)


def scaled_height(width: Column, w: Column, h: Column) -> Column:
    """The even height that keeps w : h at ``width``; halves round to even; 2 at least."""
    return F.greatest(F.lit(2), (F.bround(width * h / w / 2) * 2).cast("int"))


def frame_rate(text: Column, fallback: float = 0.0) -> Column:
    """A rational ("30000/1001") or decimal rate; the fallback if it is none or divides by zero."""
    parts = F.split(text, "/")
    top, bottom = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    rate = F.when(F.size(parts) > 1, F.try_divide(top, bottom)).otherwise(top)
    return F.coalesce(rate, F.lit(float(fallback)))


def bits_per_pixel(bit_rate: Column, w: Column, h: Column, fps: Column) -> Column:
    pixels = w.cast("double") * h * fps
    return F.when(pixels > 0, bit_rate / pixels).otherwise(F.lit(0.0))


def saved_percent(before: Column, after: Column) -> Column:
    return F.when(before > 0, (F.lit(1.0) - after / before) * 100.0).otherwise(F.lit(0.0))


def sample_windows(duration: Column, n: int, seconds: float) -> Column:
    """``array<struct<start, seconds>>``: n windows spread over a duration, or the whole if it is short."""
    each = F.greatest(F.lit(1.0), F.least(F.lit(float(seconds)), duration / n))
    spread = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(((duration - each) * (i + 0.5) / n).alias("start"), each.alias("seconds")))
    return F.when(duration <= each * n, F.array(F.struct(F.lit(0.0).alias("start"), duration.alias("seconds")))).otherwise(spread)


def sampling_rate(fps: Column, duration: Column, most: int = 800) -> Column:
    """The rate that samples at most ``most`` frames."""
    return F.when(duration * fps > most, F.try_divide(F.lit(float(most)), duration)).otherwise(fps)


def sampling_width(width: Column, aspect: Column, frames: Column, budget: int = 350 * 1024 * 1024, least: int = 256) -> Column:
    """The first of width x 0.8^k whose frames, a byte a pixel, fit the budget; ``least`` at least."""
    shrunk = F.transform(F.sequence(F.lit(0), F.lit(24)), lambda k: F.floor(width * F.pow(F.lit(0.8), k)))
    fits = F.filter(shrunk, lambda w: (w * w * aspect * frames <= budget) | (w <= least))
    return F.greatest(F.lit(least), F.coalesce(F.get(fits, F.lit(0)), F.lit(least))).cast("int")


def clamped_region(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """``struct<x, y, w, h>`` kept one pixel inside a picture, two pixels wide and high at least."""
    left = F.greatest(F.lit(1), F.least(x, width - 3))
    top = F.greatest(F.lit(1), F.least(y, height - 3))
    return F.struct(
        left.alias("x"), top.alias("y"), F.greatest(F.lit(2), F.least(w, width - 1 - left)).alias("w"), F.greatest(F.lit(2), F.least(h, height - 1 - top)).alias("h")
    )


def region_spec(text: Column) -> Column:
    """"x,y,w,h" as four integers; an error if there are not four."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p).cast("int"))
    return F.when(F.size(parts) == 4, parts).otherwise(F.raise_error(F.concat(F.lit("not x,y,w,h: "), text)).cast("array<int>"))


def same_length(value: Column, length: Column, fill: str = " ") -> Column:
    """A replacement padded to ``length`` bytes; null if it is longer."""
    return F.when(F.octet_length(value) <= length, F.rpad(value, length, F.lit(fill)))


def audio_choice(codec: Column, bit_rate: Column, mode: str = "auto") -> Column:
    """none, copy or aac: lossless codecs and more than 256 kbit/s are encoded anew."""
    heavy = codec.isin("flac", "alac", "wavpack", "truehd", "dts") | F.startswith(codec, F.lit("pcm_")) | (bit_rate > 256_000)
    chosen = F.lit(mode) if mode in ("copy", "aac") else F.when(heavy, "aac").otherwise("copy")
    return F.when(codec.isNull() | (codec == ""), "none").otherwise(chosen)


def output_scale(w: Column, h: Column, max_height: int, pix_fmt: Column) -> Column:
    """``struct<w, h, pix_fmt>``: at most ``max_height`` (even), 10 and 12 bit formats kept."""
    top = max_height - max_height % 2
    small = F.lit(max_height > 0) & (h > max_height)
    width = F.when(small, F.greatest(F.lit(2), (F.bround(w * top / h / 2) * 2).cast("int"))).otherwise(w)
    deep = F.contains(pix_fmt, F.lit("10")) | F.contains(pix_fmt, F.lit("12"))
    return F.struct(width.alias("w"), F.when(small, F.lit(top)).otherwise(h).alias("h"), F.when(deep, pix_fmt).otherwise("yuv420p").alias("pix_fmt"))


def hexdump(data: Column, base: Column, most: int = 256) -> Column:
    """Lines of sixteen bytes: offset, digits, printable gutter."""
    size = F.least(F.octet_length(data), F.lit(most))
    rows = F.when(size > 0, F.sequence(F.lit(0), F.floor((size - 1) / 16).cast("int"))).otherwise(F.array().cast("array<int>"))

    def line(k: Column) -> Column:
        part = F.substring(data, k * 16 + 1, F.least(F.lit(16), size - k * 16))
        digits = F.regexp_replace(F.lower(F.hex(part)), "(..)", "$1 ")
        gutter = F.regexp_replace(F.decode(part, "ISO-8859-1"), r"[^\x20-\x7e]", ".")
        return F.concat(F.lower(F.lpad(F.hex(base + k * 16), 8, "0")), F.lit("  "), F.rpad(digits, 48, " "), F.lit(" "), gutter)

    return F.array_join(F.transform(rows, line), "\n")


def image_kind(payload: Column) -> Column:
    from quarry.functions.rules import IMAGE_KINDS

    head, out = F.substring(payload, 1, 8), F.lit(None).cast("string")
    for prefix, name, _ in reversed(IMAGE_KINDS):
        out = F.when(F.startswith(head, F.lit(bytearray(prefix))), name).otherwise(out)
    return out
