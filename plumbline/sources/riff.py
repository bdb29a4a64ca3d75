"""RIFF audio: a chunk-walking header reader by byte ranges, decoders for its sample formats, and an encoder."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np

#: Format tags.
PCM, FLOAT, ALAW, MULAW, EXTENSIBLE = 1, 3, 6, 7, 0xFFFE
NAMES = {PCM: "pcm", FLOAT: "float", ALAW: "alaw", MULAW: "mulaw"}
#: Sizes that writers leave in a header when they don't know how much will follow.
_UNKNOWN = (0, 0xFFFFFFFF)


class UnreadableAudio(ValueError):
    """A file that is no audio, or of a kind that isn't read; says why."""


@dataclass(frozen=True)
class Header:
    kind: int
    channels: int
    rate: int
    bits: int
    block: int  # bytes of a frame
    data_at: int
    frames: int
    big: bool = False

    @property
    def encoding(self) -> str:
        return f"{NAMES[self.kind]}{self.bits}"

    @property
    def seconds(self) -> float:
        return self.frames / self.rate


def header(file: BinaryIO, length: int) -> Header:
    """Of a file of so many bytes. Only chunk heads and the format chunk are read, wherever they stand; the data's real end counts,
    whatever the header says."""
    form, _, kind = struct.unpack("<4sI4s", _exactly(file, 0, 12))
    if form not in (b"RIFF", b"RF64", b"RIFX") or kind != b"WAVE":
        raise UnreadableAudio("not a RIFF WAVE file")
    order = ">" if form == b"RIFX" else "<"
    at, fmt, data, wide = 12, None, None, None
    while at + 8 <= length and (fmt is None or data is None):
        name, size = struct.unpack(f"{order}4sI", _exactly(file, at, 8))
        if name == b"ds64":
            wide = struct.unpack("<Q", _exactly(file, at + 16, 8))[0]
        elif name == b"fmt ":
            fmt = _exactly(file, at + 8, min(size, 40))
        elif name == b"data":
            size = wide if size == 0xFFFFFFFF and wide is not None else size
            data = (at + 8, length - at - 8 if size in _UNKNOWN and fmt is not None else min(size, length - at - 8))
        at += 8 + size + size % 2
    if fmt is None or len(fmt) < 16:
        raise UnreadableAudio("no format chunk")
    if data is None:
        raise UnreadableAudio("no data chunk")
    tag, channels, rate, _, block, bits = struct.unpack(f"{order}HHIIHH", fmt[:16])
    if tag == EXTENSIBLE:
        if len(fmt) < 26:
            raise UnreadableAudio("an extensible format without its kind")
        tag = struct.unpack(f"{order}H", fmt[24:26])[0]
    if tag not in NAMES:
        raise UnreadableAudio(f"format {tag} is not supported")
    if not channels or not rate:
        raise UnreadableAudio("no channels or no sample rate")
    if bits not in {PCM: (8, 16, 24, 32), FLOAT: (32, 64), ALAW: (8,), MULAW: (8,)}[tag]:
        raise UnreadableAudio(f"{NAMES[tag]} samples of {bits} bits are not supported")
    if block != channels * bits // 8:
        raise UnreadableAudio(f"frames of {block} bytes do not hold {channels} samples of {bits} bits")
    return Header(tag, channels, rate, bits, block, data[0], data[1] // block, order == ">")


def _exactly(file: BinaryIO, at: int, n: int) -> bytes:
    file.seek(at)
    out = file.read(n)
    if len(out) < n:
        raise UnreadableAudio("the file ends within its header")
    return out


def frames(file: BinaryIO, head: Header, first: int, last: int) -> np.ndarray:
    """Frames first to last as float64, frames x channels, in -1 to 1; the file is read there alone."""
    file.seek(head.data_at + first * head.block)
    raw = file.read((last - first) * head.block)
    if len(raw) < (last - first) * head.block:
        raise UnreadableAudio("the file ends within its data")
    return decoded(raw, head).reshape(-1, head.channels)


def decoded(raw: bytes, head: Header) -> np.ndarray:
    order = ">" if head.big else "<"
    if head.kind == FLOAT:
        return np.frombuffer(raw, f"{order}f{head.bits // 8}").astype(np.float64)
    if head.kind in (ALAW, MULAW):
        return (_ALAW if head.kind == ALAW else _MULAW)[np.frombuffer(raw, np.uint8)]
    if head.bits == 8:
        return (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    if head.bits == 24:
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        wide = np.zeros((len(parts), 4), np.uint8)
        wide[:, 1:] = parts[:, ::-1] if head.big else parts
        return wide.view("<i4")[:, 0] / 2147483648.0
    return np.frombuffer(raw, f"{order}i{head.bits // 8}") / float(1 << (head.bits - 1))


def _companded(mu: bool) -> np.ndarray:
    """The values of 8-bit companded samples, by the rule of their segments."""
    code = np.arange(256)
    code = ~code & 255 if mu else code ^ 0x55
    exponent, mantissa = (code >> 4) & 7, code & 15
    if mu:
        size, sign = (((mantissa << 3) + 132) << exponent) - 132, np.where(code & 128, -1, 1)
    else:
        size = np.where(exponent == 0, (mantissa << 4) + 8, ((mantissa << 4) + 264) << np.maximum(exponent - 1, 0))
        sign = np.where(code & 128, 1, -1)
    return sign * size / 32768.0


_ALAW, _MULAW = _companded(False), _companded(True)


def encode(x: np.ndarray, rate: int, encoding: str = "pcm16", extensible: bool = False) -> bytes:
    """A WAV file of x (frames, or frames x channels, in -1 to 1). PCM clips and rounds."""
    kind, bits = (PCM, int(encoding[3:])) if encoding.startswith("pcm") else (FLOAT, int(encoding.removeprefix("float")))
    x = np.asarray(x, np.float64)
    channels = 1 if x.ndim == 1 else x.shape[1]
    if kind == FLOAT:
        raw = x.astype(f"<f{bits // 8}").tobytes()
    elif bits in (8, 16, 24, 32):
        whole = np.round(np.clip(x, -1, 1) * ((1 << (bits - 1)) - 1)).astype(np.int64)
        raw = (whole + 128).astype(np.uint8).tobytes() if bits == 8 else whole.astype("<i8").reshape(-1, 1).view(np.uint8)[:, : bits // 8].tobytes()
    else:
        raise ValueError(f"unknown encoding {encoding}")
    block = channels * bits // 8
    fmt = struct.pack("<HHIIHH", EXTENSIBLE if extensible else kind, channels, rate, rate * block, block, bits)
    if extensible:
        fmt += struct.pack("<HHIH", 22, bits, 0, kind) + bytes.fromhex("000000001000800000aa00389b71")
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(raw)) + raw + b"\0" * (len(raw) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body
