"""Decoders of coded video: configuration, NAL units, SEI messages, sequence parameters."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import schemas
from quarry.functions.boxes import parse, per_file, sample_table, tracks

MOST_SAMPLES, MOST_MESSAGES, MOST_PAYLOAD = 4000, 64, 256


def avc_config(data: bytes) -> dict | None:
    """Length size and parameter sets of an avcC body; null if it is too short."""
    if len(data) < 7:
        return None
    out, at = {"length_size": (data[4] & 3) + 1, "sps": [], "pps": []}, 6

    def take(n: int, into: list[bytes], at: int) -> int:
        for _ in range(n):
            size = int.from_bytes(data[at : at + 2], "big")
            into.append(data[at + 2 : at + 2 + size])
            at += 2 + size
        return at

    at = take(data[5] & 31, out["sps"], at)
    if at < len(data):
        take(data[at], out["pps"], at + 1)
    return out


def nal_units(data: bytes, offset: int, size: int, length_size: int) -> Iterator[tuple[int, int, int]]:
    """(offset, size, type) of a sample's length-prefixed units; ends at a bad length."""
    at, end = offset, min(offset + size, len(data))
    while at + length_size < end:
        n = int.from_bytes(data[at : at + length_size], "big")
        at += length_size
        if n == 0 or at + n > end:
            return
        yield at, n, data[at] & 31
        at += n


def unescaped(data: bytes) -> bytes:
    """Without the emulation prevention bytes (00 00 03)."""
    out, zeros = bytearray(), 0
    for b in data:
        if zeros >= 2 and b == 3:
            zeros = 0
            continue
        out.append(b)
        zeros = zeros + 1 if b == 0 else 0
    return bytes(out)


def sei_messages(unit: bytes) -> list[tuple[int, int, str | None, bytes]]:
    """(type, size, uuid of types 4 and 5, first payload bytes) of an SEI unit."""
    data, at, out = unescaped(unit[1:]), 0, []

    def extended(at: int) -> tuple[int, int]:
        total = 0
        while at < len(data) and data[at] == 255:
            total, at = total + 255, at + 1
        return (total + data[at], at + 1) if at < len(data) else (-1, at)

    while at + 2 <= len(data) and len(out) < MOST_MESSAGES and data[at] != 0x80:
        kind, at = extended(at)
        size, at = extended(at)
        if kind < 0 or size < 0 or at + size > len(data):
            break
        payload = data[at : at + size]
        out.append((kind, size, payload[:16].hex() if kind in (4, 5) and size >= 16 else None, payload[:MOST_PAYLOAD]))
        at += size
    return out


class Bits:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), len(data) * 8

    def take(self, n: int) -> int:
        if n > self.left:
            raise ValueError("past the end")
        self.left -= n
        return self.value >> self.left & ((1 << n) - 1)

    def ue(self) -> int:
        zeros = 0
        while self.take(1) == 0:
            zeros += 1
        return (1 << zeros) - 1 + self.take(zeros)

    def se(self) -> int:
        k = self.ue()
        return (k + 1) // 2 if k % 2 else -(k // 2)


# Profiles whose parameter sets carry a chroma format.
_CHROMA_PROFILES = {100, 110, 122, 244, 44, 83, 86, 118, 128, 138, 139, 134, 135}


def sps(unit: bytes) -> dict | None:
    """Profile, level and picture size of a sequence parameter set; null if it cannot be read."""
    try:
        bits = Bits(unescaped(unit[1:]))
        profile, _, level = bits.take(8), bits.take(8), bits.take(8)
        bits.ue()
        chroma = 1
        if profile in _CHROMA_PROFILES:
            chroma = bits.ue()
            if chroma == 3:
                bits.take(1)
            bits.ue(), bits.ue(), bits.take(1)
            if bits.take(1):
                for k in range(8 if chroma != 3 else 12):
                    if bits.take(1):
                        last = step = 8
                        for _ in range(16 if k < 6 else 64):
                            if step:
                                step = (last + bits.se()) % 256
                            last = step or last
        bits.ue()
        order = bits.ue()
        if order == 0:
            bits.ue()
        elif order == 1:
            bits.take(1), bits.se(), bits.se()
            for _ in range(bits.ue()):
                bits.se()
        bits.ue(), bits.take(1)
        across, down, frames = bits.ue() + 1, bits.ue() + 1, bits.take(1)
        if not frames:
            bits.take(1)
        bits.take(1)
        crop = [bits.ue() for _ in range(4)] if bits.take(1) else [0, 0, 0, 0]
    except ValueError:
        return None
    x_unit, y_unit = (1 if chroma in (0, 3) else 2), (2 if chroma == 1 else 1) * (2 - frames)
    return {
        "profile_idc": profile, "level_idc": level, "chroma_format_idc": chroma, "frame_mbs_only": bool(frames), "crop": crop,
        "width": across * 16 - x_unit * (crop[0] + crop[1]), "height": (2 - frames) * down * 16 - y_unit * (crop[2] + crop[3]),
    }


def _first_video(data: bytes, tree=None):
    """(configuration, samples) of the first video track with an avcC; null parts if there is none."""
    tree = tree or parse(data)
    for _, trak, kind, stbl in tracks(data, tree):
        if kind == "vide" and stbl:
            box = tree.first(trak, "avcC")
            return (avc_config(data[box.body : box.end]) if box else None), sample_table(data, tree, stbl)[0]
    return None, []


def nal_rows(video: str, data: bytes, most: int = MOST_SAMPLES, tree=None) -> Iterator[tuple]:
    config, placed = _first_video(data, tree)
    if config:
        for k, (offset, size) in enumerate(placed[:most]):
            for at, n, kind in nal_units(data, offset, size, config["length_size"]):
                yield video, k, at, n, kind


def sei_rows(video: str, data: bytes, most: int = MOST_SAMPLES, tree=None) -> Iterator[tuple]:
    for _, k, at, n, kind in nal_rows(video, data, most, tree):
        if kind == 6:
            for type_, size, uuid, payload in sei_messages(data[at : at + n]):
                yield video, k, at, type_, size, uuid, payload


def sps_rows(video: str, data: bytes, tree=None) -> Iterator[tuple]:
    config, _ = _first_video(data, tree)
    for unit in config["sps"] if config else []:
        if found := sps(unit):
            yield video, *(found[c.split()[0]] for c in schemas.SPS.split(", "))


def nals(files: DataFrame, deep: bool = False, **names: str) -> DataFrame:
    """Units of the first video track, of its first 4000 samples unless ``deep``."""
    most = 2**62 if deep else MOST_SAMPLES
    return per_file(files, lambda v, d: nal_rows(v, d, most), schemas.NALS, **names)


def sei(files: DataFrame, deep: bool = False, **names: str) -> DataFrame:
    most = 2**62 if deep else MOST_SAMPLES
    return per_file(files, lambda v, d: sei_rows(v, d, most), schemas.SEI, **names)


def sequence_parameters(files: DataFrame, **names: str) -> DataFrame:
    return per_file(files, sps_rows, f"video_id string, {schemas.SPS}", **names)


def nal_histogram(units: DataFrame) -> DataFrame:
    return units.groupBy("video_id", "nal_type").agg(F.count(F.lit(1)).alias("n"))


def sei_summary(messages: DataFrame) -> DataFrame:
    """By uuid, or type where there is none: how many, and the first sample and offset."""
    mark = F.coalesce("uuid", F.concat(F.lit("type "), F.col("type").cast("string")))
    return messages.groupBy("video_id", mark.alias("mark")).agg(F.count(F.lit(1)).alias("n"), F.min("sample_no").alias("first_sample"), F.min_by("offset", "sample_no").alias("first_offset"))
