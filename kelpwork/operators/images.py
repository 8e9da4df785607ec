"""Pixels: decoding, resizing, cropping, normalising, augmenting. With ``decoders`` the only Python on the way of image data."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpwork.operators.decoders import NoDecoder, decode

#: Channel means and deviations of the usual pretraining images.
MEAN = (0.485, 0.456, 0.406)
STD = (0.229, 0.224, 0.225)


def normalized(values: Column, mean: Sequence[float], std: Sequence[float], channels: int | None = None) -> Column:
    """(x - mean) / std of a flat channel-first array; each channel takes an equal part of it."""
    channels = channels or len(mean)
    m, s = F.array(*[F.lit(float(x)) for x in mean]), F.array(*[F.lit(float(x)) for x in std])
    channel = lambda i: F.floor(i * channels / F.size(values)).cast("int")
    return F.transform(values, lambda x, i: (x.cast("double") - F.get(m, channel(i))) / F.get(s, channel(i)))


def gray_bytes(values: Column) -> Column:
    """An array of numbers as bytes: each clipped to -3..3 and spread over 0..255."""
    byte = lambda x: F.lpad(F.hex(F.floor((F.greatest(F.lit(-3.0), F.least(F.lit(3.0), x.cast("double"))) + 3.0) * 42.5).cast("int")), 2, "0")
    return F.unhex(F.array_join(F.transform(values, byte), ""))


def decode_raw_square(data: bytes) -> np.ndarray:
    """Square gray picture from its bytes."""
    side = int(len(data) ** 0.5)
    if side == 0 or side * side != len(data):
        raise ValueError("no square")
    return np.frombuffer(data, np.uint8).reshape(side, side)


def decode_png(data: bytes) -> np.ndarray:
    """8-bit gray, gray with alpha, RGB or RGBA PNG without interlacing, as gray or RGB."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, header, packed = 8, None, b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    width, height, depth, colour, _, _, interlace = header
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    if depth != 8 or interlace:
        raise ValueError("only 8 bits without interlacing")
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * channels)
    out, before = np.zeros((height, width, channels), np.uint8), np.zeros((width, channels), np.uint8)
    for y in range(height):
        line, kind = raw[y, 1:].reshape(width, channels), raw[y, 0]
        if kind == 1:  # each channel is a running sum
            line = np.cumsum(line, axis=0, dtype=np.uint8)
        elif kind == 2:
            line = line + before
        elif kind in (3, 4):
            line = _from_left(line.tolist(), before.tolist(), kind)
        out[y] = before = line
    return out[:, :, 0] if channels <= 2 else out[:, :, :3]


def _from_left(line: list[list[int]], above: list[list[int]], kind: int) -> list[list[int]]:
    """Undoes the two filters in which a pixel depends on the one before it in a way that has no closed form."""
    left = corner = [0] * len(line[0])
    out = []
    for sent, up in zip(line, above):
        if kind == 3:
            left = [(s + (a + b) // 2) & 255 for s, a, b in zip(sent, left, up)]
        else:
            left = [(s + _paeth(a, b, c)) & 255 for s, a, b, c in zip(sent, left, up, corner)]
        out.append(left)
        corner = up
    return out


def _paeth(left: int, up: int, corner: int) -> int:
    """Of the three neighbours the one nearest to left + up - corner; of equal ones the first."""
    away = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
    return (left, up, corner)[away.index(min(away))]


def decode_pnm(data: bytes) -> np.ndarray:
    """PBM, PGM or PPM, plain or binary, of up to 16 bits, as 8 bits."""
    kind, rest, numbers = data[:2], data[2:], []
    channels = {b"P1": 1, b"P2": 1, b"P3": 3, b"P4": 1, b"P5": 1, b"P6": 3}[kind]
    bitmap = kind in (b"P1", b"P4")
    while len(numbers) < 3 - bitmap:
        rest = rest.lstrip()
        if rest.startswith(b"#"):
            rest = rest.partition(b"\n")[2]
            continue
        word = rest[:20].split(maxsplit=1)[0]
        numbers.append(int(word))
        rest = rest[len(word) :]
    (width, height), full = numbers[:2], 1 if bitmap else numbers[2]
    n = width * height * channels
    if kind == b"P4":
        line = -(-width // 8)
        pixels = np.unpackbits(np.frombuffer(rest[1 : 1 + line * height], np.uint8).reshape(height, line), axis=1)[:, :width]
    elif kind == b"P1":
        pixels = np.frombuffer(bytes(b"".join(x.partition(b"#")[0] for x in rest.split(b"\n")).translate(None, b" \t\r\v\f")[:n]), np.uint8) - ord("0")
    elif kind in (b"P2", b"P3"):
        pixels = np.array(b" ".join(x.partition(b"#")[0] for x in rest.split(b"\n")).split()[:n], dtype=int)
    else:
        wide = 1 if full < 256 else 2
        pixels = np.frombuffer(rest[1 : 1 + n * wide], ">u2" if wide == 2 else np.uint8)
    pixels = pixels.reshape(height, width, channels)
    if bitmap:
        pixels = 1 - pixels
    if full != 255:
        pixels = np.minimum((pixels * (255 / full)).round(), 255)
    pixels = pixels.astype(np.uint8)
    return pixels[:, :, 0] if channels == 1 else pixels


def decode_any(data: bytes) -> np.ndarray:
    """Gray or RGB; raises ``NoDecoder`` for a format that nothing here reads, another error for a bad picture."""
    if data[:1] == b"P" and data[1:2] in b"123456":
        return decode_pnm(data)
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[24:25] == b"\x08" and data[25:26] in b"\0\2\4\6" and data[28:29] == b"\0":
        return decode_png(data)
    return decode(data)


def to_gray(pixels: np.ndarray) -> np.ndarray:
    return pixels if pixels.ndim == 2 else pixels @ np.array([0.299, 0.587, 0.114])


def decode_gray(data: bytes) -> np.ndarray:
    return to_gray(decode_any(data))


def to_rgb(pixels: np.ndarray) -> np.ndarray:
    return np.repeat(pixels[:, :, None], 3, 2) if pixels.ndim == 2 else pixels


def resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""

    def places(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    x = pixels.astype(float)
    a, b, f = places(x.shape[0], height)
    x = x[a] * (1 - f)[:, None, None] + x[b] * f[:, None, None]
    a, b, f = places(x.shape[1], width)
    return x[:, a] * (1 - f)[None, :, None] + x[:, b] * f[None, :, None]


def resize_shorter(pixels: np.ndarray, size: int) -> np.ndarray:
    h, w = pixels.shape[:2]
    return resize(pixels, size, max(1, int(size * w / h))) if h <= w else resize(pixels, max(1, int(size * h / w)), size)


def centre_crop(pixels: np.ndarray, size: int) -> np.ndarray:
    top, left = round((pixels.shape[0] - size) / 2), round((pixels.shape[1] - size) / 2)
    return pixels[top : top + size, left : left + size]


def _tensor(pixels: np.ndarray) -> np.ndarray:
    return ((pixels / 255 - np.array(MEAN)) / np.array(STD)).transpose(2, 0, 1).astype(np.float32)


def eval_transform(pixels: np.ndarray, size: int = 224) -> np.ndarray:
    """Shorter side to round(size * 256 / 224), centre crop, channel-first fractions, normalised."""
    return _tensor(centre_crop(resize_shorter(to_rgb(pixels), round(size * 256 / 224)), size))


def _rotate(pixels: np.ndarray, degrees: float) -> np.ndarray:
    h, w = pixels.shape[:2]
    y, x = np.mgrid[:h, :w]
    a = np.deg2rad(degrees)
    cy, cx = (h - 1) / 2, (w - 1) / 2
    v = np.round(cy + (y - cy) * np.cos(a) - (x - cx) * np.sin(a)).astype(int)
    u = np.round(cx + (y - cy) * np.sin(a) + (x - cx) * np.cos(a)).astype(int)
    inside = (v >= 0) & (v < h) & (u >= 0) & (u < w)
    return np.where(inside[:, :, None], pixels[np.clip(v, 0, h - 1), np.clip(u, 0, w - 1)], 0)


def _affine(pixels: np.ndarray, shear_x: float = 0, shear_y: float = 0, right: float = 0, down: float = 0) -> np.ndarray:
    """Nearest pixels of a shear about the centre and a shift; what comes from outside is black."""
    h, w = pixels.shape[:2]
    y, x = np.mgrid[:h, :w]
    u = np.round(x - right - shear_x * (y - (h - 1) / 2)).astype(int)
    v = np.round(y - down - shear_y * (x - (w - 1) / 2)).astype(int)
    inside = (v >= 0) & (v < h) & (u >= 0) & (u < w)
    return np.where(inside[:, :, None], pixels[np.clip(v, 0, h - 1), np.clip(u, 0, w - 1)], 0)


def _blend(pixels: np.ndarray, other: np.ndarray | float, factor: float) -> np.ndarray:
    return np.clip(other + (pixels - other) * factor, 0, 255)


def _smooth(pixels: np.ndarray) -> np.ndarray:
    """Means over 3 x 3 with a heavy centre (5 of 13); the border stays."""
    out = pixels.copy()
    if min(pixels.shape[:2]) > 2:
        h, w = pixels.shape[:2]
        parts = [pixels[i : h - 2 + i, j : w - 2 + j] for i in range(3) for j in range(3)]
        out[1:-1, 1:-1] = (sum(parts) + 4 * parts[4]) / 13
    return out


def _stretched(pixels: np.ndarray) -> np.ndarray:
    """Each channel spread over 0..255."""
    low, high = pixels.min((0, 1)), pixels.max((0, 1))
    return np.where(high > low, (pixels - low) * (255 / np.maximum(high - low, 1e-9)), pixels)


def _equalized(pixels: np.ndarray) -> np.ndarray:
    """Each channel's values replaced by their share of smaller or equal ones."""
    out = np.empty_like(pixels)
    for c in range(pixels.shape[2]):
        values = np.clip(pixels[:, :, c], 0, 255).astype(int)
        up_to = np.cumsum(np.bincount(values.ravel(), minlength=256))
        first = up_to[values.min()]
        out[:, :, c] = pixels[:, :, c] if first == values.size else ((up_to - first) * 255 / (values.size - first))[values]
    return out


#: The range of each random operation at the full magnitude of 30.
FULL = {"shear": 0.3, "shift": 150 / 331, "degrees": 30, "factor": 0.9, "bits": 4}


def _operations(size: int, level: float, sign: float) -> list[Callable[[np.ndarray], np.ndarray]]:
    """The fourteen random operations at ``level`` 0..1; ``sign`` is the direction of those that have one."""
    at = {k: v * level for k, v in FULL.items()}
    factor, step = 1 + sign * at["factor"], 2.0 ** round(at["bits"])
    return [
        lambda p: p,
        lambda p: _affine(p, shear_x=sign * at["shear"]),
        lambda p: _affine(p, shear_y=sign * at["shear"]),
        lambda p: _affine(p, right=sign * at["shift"] * size),
        lambda p: _affine(p, down=sign * at["shift"] * size),
        lambda p: _rotate(p, sign * at["degrees"]),
        lambda p: _blend(p, 0.0, factor),
        lambda p: _blend(p, to_gray(p)[:, :, None], factor),
        lambda p: _blend(p, to_gray(p).mean(), factor),
        lambda p: _blend(p, _smooth(p), factor),
        lambda p: np.floor(p / step) * step,
        lambda p: np.where(p >= 255 * (1 - level), 255 - p, p),
        _stretched,
        _equalized,
    ]


def _hue_turned(pixels: np.ndarray, turn: float) -> np.ndarray:
    """Colours with their hue moved by ``turn`` of the circle; brightness and saturation stay."""
    if not turn:
        return pixels
    high, low = pixels.max(2), pixels.min(2)
    span = np.maximum(high - low, 1e-9)
    r, g, b = pixels[:, :, 0], pixels[:, :, 1], pixels[:, :, 2]
    sixth = np.where(high == r, (g - b) / span % 6, np.where(high == g, (b - r) / span + 2, (r - g) / span + 4))
    at = (sixth + 6 * turn) % 6
    near = [np.clip(np.abs((at - k + 3) % 6 - 3) - 1, 0, 1) for k in (0, 2, 4)]  # 0 within a sixth of the pure colour
    return np.dstack([high - (high - low) * n for n in near])


@dataclass(frozen=True)
class Augmentation:
    """Settings of the training transform. The defaults hold where a configuration has no ``augmentation``; of one that
    has, an absent rotation is 0, an absent part of the jitter 0 and an absent magnitude 9. A flip is never made."""

    scale: tuple[float, float] = (0.7, 1.0)
    degrees: float = 10
    brightness: float = 0.2
    contrast: float = 0.2
    saturation: float = 0.2
    hue: float = 0.0
    num_ops: int = 2
    magnitude: int = 7

    @classmethod
    def of(cls, config: dict) -> Augmentation:
        held = config.get("augmentation")
        if not held:
            return cls()
        jitter, random = held.get("color_jitter") or {}, held.get("rand_augment") or {}
        parts = [float(jitter.get(k, 0.0)) for k in ("brightness", "contrast", "saturation", "hue")]
        scale = (held.get("random_resized_crop") or {}).get("scale", cls.scale)
        return cls(tuple(scale), float(held.get("rotation_degrees", 0)), *parts, int(random.get("num_ops", 2)), int(random.get("magnitude", 9)))


def train_transform(pixels: np.ndarray, rng: np.random.Generator, size: int = 224, how: Augmentation = Augmentation()) -> np.ndarray:
    """Random resized crop, rotation, colour jitter, then random operations; never a flip."""
    pixels = to_rgb(pixels)
    h, w = pixels.shape[:2]
    share, ratio = rng.uniform(*how.scale), np.exp(rng.uniform(np.log(3 / 4), np.log(4 / 3)))
    ch, cw = min(h, max(1, round((h * w * share / ratio) ** 0.5))), min(w, max(1, round((h * w * share * ratio) ** 0.5)))
    top, left = rng.integers(h - ch + 1), rng.integers(w - cw + 1)
    x = resize(pixels[top : top + ch, left : left + cw], size, size)
    x = _rotate(x, rng.uniform(-how.degrees, how.degrees))
    about = lambda spread: rng.uniform(max(0, 1 - spread), 1 + spread)
    x = _blend(x, 0.0, about(how.brightness))
    x = _blend(x, to_gray(x).mean(), about(how.contrast))
    x = _blend(x, to_gray(x)[:, :, None], about(how.saturation))
    x = _hue_turned(x, rng.uniform(-how.hue, how.hue))
    for _ in range(how.num_ops):
        operations = _operations(size, how.magnitude / 30, rng.choice([-1.0, 1.0]))
        x = np.clip(operations[rng.integers(len(operations))](x), 0, 255)
    return _tensor(x)


#: Pictures whose tensors leave a task at once: 32 of 3 x 224 x 224 floats are 19 MB.
SLICE = 32


def _tensors(images: DataFrame, key: str, decode, content: str, transform) -> DataFrame:
    def made(k: object, data: bytes) -> np.ndarray | None:
        try:
            return transform(decode(data), k).ravel()
        except NoDecoder:
            raise
        except Exception:  # as for fingerprints
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), SLICE):
                part = pdf.iloc[at : at + SLICE]
                yield pd.DataFrame({"key": part["key"], "tensor": [made(k, data) for k, data in zip(part["key"], part["content"])]})

    rows = images.select(F.col(key).alias("key"), F.col(content).alias("content"))
    return rows.mapInPandas(run, f"key {rows.schema['key'].dataType.simpleString()}, tensor array<float>").withColumnRenamed("key", key)


def eval_tensors(images: DataFrame, key: str, decode=decode_any, content: str = "content", size: int = 224) -> DataFrame:
    """``(key, tensor)``, channel-first and flat; null for unreadable images."""
    return _tensors(images, key, decode, content, lambda pixels, _: eval_transform(pixels, size))


def train_tensors(images: DataFrame, key: str, seed: int = 0, epoch: int = 0, decode=decode_any, content: str = "content", size: int = 224, how: Augmentation = Augmentation()) -> DataFrame:
    """The same with augmentation; an image's randomness comes from seed, epoch and key alone."""
    return _tensors(images, key, decode, content, lambda pixels, k: train_transform(pixels, np.random.default_rng([seed, epoch, zlib.crc32(str(k).encode())]), size, how))
