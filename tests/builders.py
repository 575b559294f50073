"""Containers and bit streams made byte by byte."""

import struct


def box(kind: str | bytes, *payload: bytes) -> bytes:
    body = b"".join(payload)
    return struct.pack(">I", 8 + len(body)) + (kind.encode("latin-1") if isinstance(kind, str) else kind) + body


def full(kind: str, *payload: bytes) -> bytes:
    return box(kind, bytes(4), *payload)


def u32(*values: int) -> bytes:
    return struct.pack(f">{len(values)}I", *values)


def stbl(sizes, chunks, runs, wide=False, extra=b"") -> bytes:
    return box(
        "stbl",
        full("stsz", u32(0, len(sizes), *sizes)),
        full("stsc", u32(len(runs), *[v for f, n in runs for v in (f, n, 1)])),
        full("co64", u32(len(chunks)), struct.pack(f">{len(chunks)}Q", *chunks)) if wide else full("stco", u32(len(chunks), *chunks)),
        extra,
    )


def trak(kind: str, table: bytes, *extra: bytes) -> bytes:
    return box("trak", *extra, box("mdia", full("hdlr", bytes(4), kind.encode(), bytes(12), b"name\0"), box("minf", table)))


def movie(table: bytes, media: bytes, kind="vide", *extra: bytes) -> bytes:
    return box("ftyp", b"isom\0\0\0\0") + box("moov", trak(kind, table, *extra)) + box("mdat", media)


class BitWriter:
    def __init__(self):
        self.bits = ""

    def put(self, value: int, n: int):
        self.bits += format(value, f"0{n}b")
        return self

    def ue(self, value: int):
        text = format(value + 1, "b")
        self.bits += "0" * (len(text) - 1) + text
        return self

    def bytes(self) -> bytes:
        bits = self.bits + "1"
        bits += "0" * (-len(bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big")


def sps_1080() -> bytes:
    w = BitWriter().put(77, 8).put(0, 8).put(40, 8).ue(0).ue(0).ue(0).ue(0).ue(1).put(0, 1).ue(119).ue(67).put(1, 1).put(1, 1)
    w.put(1, 1).ue(0).ue(0).ue(0).ue(4).put(0, 1)
    return b"\x67" + w.bytes()


def sei_unit(*messages: tuple[int, bytes]) -> bytes:
    body = b"".join(bytes([k]) + b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) + p for k, p in messages)
    return b"\x06" + body + b"\x80"
