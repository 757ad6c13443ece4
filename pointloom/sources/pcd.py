"""The PCD file format: header, plain and compressed bodies."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

#: A header is far shorter; so much is read to find its end.
HEAD_BYTES = 1 << 16
_CODES = {"F": "f", "I": "i", "U": "u"}


@dataclass(frozen=True)
class PcdHead:
    """Field layout and the place of the body."""

    kind: str
    names: list[str]
    dtype: np.dtype
    counts: list[int]
    points: int
    body: int


def parse_head(content: bytes) -> PcdHead:
    """Header of a PCD file from its first bytes."""
    end = content.index(b"\n", content.index(b"\nDATA ") + 1)
    lines = [x for x in content[:end].decode("ascii").splitlines() if " " in x and not x.startswith("#")]
    fields = dict(x.split(None, 1) for x in lines)
    names, sizes, types = (fields[k].split() for k in ("FIELDS", "SIZE", "TYPE"))
    counts = [int(c) for c in fields.get("COUNT", " ".join("1" for _ in names)).split()]
    dtype = np.dtype([(f"{i}_{n}", f"<{_CODES[t]}{s}", (c,)) for i, (n, s, t, c) in enumerate(zip(names, sizes, types, counts))])
    kind = fields["DATA"].strip()
    if kind not in ("ascii", "binary", "binary_compressed"):
        raise ValueError(f"PCD data kind {kind!r} is not supported")
    return PcdHead(kind, names, dtype, counts, int(fields["POINTS"]), end + 1)


def lzf_expand(data: bytes, size: int) -> bytes:
    """Undo LZF: runs of literal bytes, and copies of earlier output that may overlap their target."""
    out, at, end = bytearray(), 0, len(data)
    while at < end:
        control = data[at]
        at += 1
        if control < 32:  # the next control + 1 bytes as they are
            out += data[at : at + control + 1]
            at += control + 1
            continue
        length = control >> 5
        if length == 7:
            length += data[at]
            at += 1
        back = ((control & 31) << 8) + data[at] + 1
        at += 1
        start = len(out) - back
        if start < 0:
            raise ValueError("LZF copy before the start of the output")
        length += 2
        piece = bytes(out[start : start + length])
        out += (piece * (length // len(piece) + 1))[:length]
    if len(out) != size:
        raise ValueError(f"LZF data of {len(out)} bytes, not {size}")
    return bytes(out)


def _columns(head: PcdHead, rows: np.ndarray) -> np.ndarray:
    return np.stack([rows[f"{head.names.index(a)}_{a}"][:, 0] for a in "xyz"], axis=1).astype(np.float32)


def parse_body(head: PcdHead, body: bytes) -> np.ndarray:
    """x, y, z of the points in ``body``: a whole body, or whole points of a plain binary one."""
    if head.kind == "ascii":
        width = sum(head.counts)
        at = [sum(head.counts[: head.names.index(a)]) for a in "xyz"]
        cells = np.array(body.split(), dtype=np.float64)
        return cells.reshape(-1, width)[:, at].astype(np.float32)
    if head.kind == "binary":
        return _columns(head, np.frombuffer(body[: len(body) // head.dtype.itemsize * head.dtype.itemsize], head.dtype))
    packed, size = struct.unpack_from("<II", body)
    plain = lzf_expand(body[8 : 8 + packed], size)
    out, at = {}, 0  # compressed bodies hold field after field
    for name, field in zip(head.names, head.dtype.names):
        kind, shape = head.dtype[field].subdtype
        n = head.points * shape[0]
        out.setdefault(name, np.frombuffer(plain, kind, n, at).reshape(-1, shape[0])[:, 0])
        at += n * kind.itemsize
    return np.stack([out[a] for a in "xyz"], axis=1).astype(np.float32)


def parse_pcd(content: bytes) -> np.ndarray:
    """x, y, z of an ASCII, binary or compressed PCD file."""
    head = parse_head(content)
    body = content[head.body :]
    if head.kind == "binary":
        body = body[: head.points * head.dtype.itemsize]
    return parse_body(head, body)
