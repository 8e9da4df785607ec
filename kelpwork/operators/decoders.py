"""Pictures that ``images`` doesn't decode itself: by Pillow where a worker can import it, else by the JVM's ImageIO."""

from __future__ import annotations

import atexit
import base64
import glob
import io
import os
import shutil

import numpy as np

_ARGB, _GRAY = 2, 6  # BufferedImage.TYPE_INT_ARGB, ColorSpace.TYPE_GRAY
#: Pixels that cross from the JVM at once.
STRIP = 1 << 20


class NoDecoder(RuntimeError):
    """This machine has nothing that reads a format; no fault of the picture, so it must end the run."""


def pillow(data: bytes) -> np.ndarray:
    from PIL import Image

    with Image.open(io.BytesIO(data)) as picture:
        if picture.mode.startswith("I;16"):
            return (np.asarray(picture, np.float64) / 257).round().astype(np.uint8)
        return np.asarray(picture.convert("L" if picture.mode in ("1", "L", "LA") else "RGB"))


def has_pillow() -> bool:
    try:
        import PIL.Image  # noqa: F401
    except ImportError:
        return False
    return True


def _java() -> str:
    found = [os.path.join(os.environ["JAVA_HOME"], "bin", "java")] if os.environ.get("JAVA_HOME") else []
    found = [x for x in [*found, shutil.which("java")] if x and os.path.exists(x)]
    if not found:
        raise NoDecoder("neither Pillow nor a Java program (JAVA_HOME, PATH) to decode pictures with")
    return found[0]


def _jar() -> str:
    import pyspark

    homes = [os.environ.get("SPARK_HOME"), os.path.dirname(pyspark.__file__)]
    found = [x for h in homes if h for x in glob.glob(os.path.join(h, "jars", "py4j-*.jar"))]
    if not found:
        raise NoDecoder("no Py4J archive in SPARK_HOME/jars to decode pictures with")
    return found[0]


class ImageIO:
    """ImageIO in a JVM of this process, which ends with it. It reads JPEG, PNG, BMP, TIFF and GIF."""

    def __init__(self):
        from py4j.java_gateway import GatewayParameters, JavaGateway, launch_gateway

        options = ["-Djava.awt.headless=true", "-XX:+UseSerialGC", "-XX:TieredStopAtLevel=1", "-Xmx1g"]
        try:
            port, token = launch_gateway(jarpath=_jar(), java_path=_java(), javaopts=options, die_on_exit=True, enable_auth=True)
            self.gateway = JavaGateway(gateway_parameters=GatewayParameters(port=port, auth_token=token, auto_convert=False))
            self.jvm = self.gateway.jvm
            self.io = self.jvm.javax.imageio.ImageIO
            self.io.setUseCache(False)
        except NoDecoder:
            raise
        except Exception as e:
            raise NoDecoder(f"the JVM that decodes pictures didn't start: {e}") from e
        self.owner = os.getpid()
        atexit.register(self.gateway.shutdown)

    def _bytes(self, ints) -> bytes:
        """Big-endian bytes of an array in the JVM, as one text: Py4J takes byte arrays apart in Python."""
        out = self.jvm.java.nio.ByteBuffer.allocate(4 * len(ints))
        out.asIntBuffer().put(ints)
        coded = self.jvm.java.util.Base64.getEncoder().encode(out)
        return base64.b64decode(self.jvm.java.nio.charset.StandardCharsets.ISO_8859_1.decode(coded).toString())

    def _samples(self, raster, band: int, top: int, rows: int) -> np.ndarray:
        width = raster.getWidth()
        held = raster.getSamples(0, top, width, rows, band, self.gateway.new_array(self.jvm.int, width * rows))
        full = (1 << raster.getSampleModel().getSampleSize(band)) - 1
        return (np.frombuffer(self._bytes(held), ">i4").reshape(rows, width) * (255 / full)).round().astype(np.uint8)

    def _bands(self, raster, bands: int) -> np.ndarray:
        height, step = raster.getHeight(), max(1, STRIP // raster.getWidth())
        return np.vstack([np.dstack([self._samples(raster, b, y, min(step, height - y)) for b in range(bands)]) for y in range(0, height, step)])

    def _coloured(self, picture) -> np.ndarray:
        width, height = picture.getWidth(), picture.getHeight()
        step, out = max(1, STRIP // width), []
        for y in range(0, height, step):
            strip = self.jvm.java.awt.image.BufferedImage(width, min(step, height - y), _ARGB)
            pen = strip.createGraphics()
            pen.setComposite(self.jvm.java.awt.AlphaComposite.Src)  # alpha is left out, not blended
            pen.drawImage(picture, 0, -y, None)
            pen.dispose()
            out.append(np.frombuffer(self._bytes(strip.getRaster().getDataBuffer().getData()), np.uint8).reshape(-1, width, 4)[:, :, 1:])
        return np.vstack(out)

    def __call__(self, data: bytes) -> np.ndarray:
        """Gray or RGB."""
        stream = self.io.createImageInputStream(self.jvm.java.io.ByteArrayInputStream(data))
        readers = self.io.getImageReaders(stream)
        if not readers.hasNext():
            raise ValueError("no picture")
        reader = readers.next()
        try:
            reader.setInput(stream, True, True)
            if data[:2] == b"\xff\xd8" and (n := _jpeg_channels(data)) == 4:
                return _of_inks(self._bands(reader.readRaster(0, None), n), data)
            picture = reader.read(0)
            if picture.getColorModel().getColorSpace().getType() == _GRAY:
                return self._bands(picture.getRaster(), 1)[:, :, 0]
            return self._coloured(picture)
        finally:
            reader.dispose()


def _segments(data: bytes):
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        yield kind, data[at + 4 : at + 2 + int.from_bytes(data[at + 2 : at + 4], "big")]
        if kind == 0xDA:
            return
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")


def _jpeg_channels(data: bytes) -> int:
    return next((body[5] for kind, body in _segments(data) if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC) and len(body) > 5), 0)


def _of_inks(x: np.ndarray, data: bytes) -> np.ndarray:
    """RGB of a JPEG in CMYK or YCCK, which Adobe's files hold inverted."""
    adobe = next((body for kind, body in _segments(data) if kind == 0xEE and body[:5] == b"Adobe" and len(body) >= 12), None)
    x = x.astype(float)
    if adobe and adobe[11] == 2:
        y, cb, cr = x[:, :, 0], x[:, :, 1] - 128, x[:, :, 2] - 128
        x[:, :, :3] = 255 - np.clip(np.dstack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]), 0, 255)
    if not adobe:
        x = 255 - x
    return (x[:, :, :3] * x[:, :, 3:] / 255).round().astype(np.uint8)


_image_io: ImageIO | None = None


def decode(data: bytes) -> np.ndarray:
    """JPEG, PNG, BMP, TIFF, GIF and WebP. Raises ``NoDecoder`` if there's nothing here that reads the format."""
    global _image_io
    if has_pillow():
        return pillow(data)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        raise NoDecoder("WebP is read by Pillow only, and the workers can't import it; install it there or leave the .webp files out of the tree")
    if not data.startswith((b"\xff\xd8", b"\x89PNG\r\n\x1a\n", b"BM", b"II*\0", b"MM\0*", b"GIF8")):
        raise ValueError("no picture")
    if _image_io is None or _image_io.owner != os.getpid():
        _image_io = ImageIO()
    return _image_io(data)
