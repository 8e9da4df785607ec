import base64
import json

import numpy as np
import pytest

from kelpwork import pipeline
from kelpwork.operators import fingerprint, images
from kelpwork.sources.sinks import read_index

Y, X = np.mgrid[:40, :48]


def picture(k):
    return np.dstack([X * (k + 2) % 256, Y * 6, (X * k + Y * 3) % 256]).astype(np.uint8)


def written(spark, kind, pixels):
    """A picture as the JVM's own writers have it; gray ones of 8 or 16 bits, colours of 8."""
    jvm, sent = spark._jvm, spark.sparkContext._gateway.new_array
    h, w = pixels.shape[:2]
    form = {(2, 1): 10, (2, 2): 11, (3, 1): 5}[pixels.ndim, pixels.itemsize]
    made, values = jvm.java.awt.image.BufferedImage(w, h, form), sent(jvm.int, pixels.size)
    jvm.java.nio.ByteBuffer.wrap(pixels.astype(">i4").tobytes()).asIntBuffer().get(values)
    made.getRaster().setPixels(0, 0, w, h, values)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(made, kind, out)
    return base64.b64decode(jvm.java.util.Base64.getEncoder().encodeToString(out.toByteArray()))


@pytest.mark.parametrize("kind, most", [("jpg", 40), ("bmp", 0), ("tiff", 0), ("png", 0)])
def test_formats(spark, kind, most):
    want = picture(2)
    assert np.abs(images.decode_any(written(spark, kind, want)).astype(int) - want).max() <= most
    gray = np.ascontiguousarray(want[:, :, 1])
    assert np.abs(images.decode_any(written(spark, kind, gray)).astype(int) - gray).max() <= most


def test_sixteen_bits(spark):
    gray = np.ascontiguousarray(picture(1)[:, :, 1])
    for kind in ("png", "tiff"):
        assert (images.decode_any(written(spark, kind, gray.astype(np.uint16) * 257)) == gray).all()
    assert (images.decode_any(b"P5 48 40 65535\n" + (gray.astype(">u2") * 257).astype(">u2").tobytes()) == gray).all()
    assert images.decode_any(b"P2\n# x\n2 1\n15\n0 15\n").tolist() == [[0, 255]] and images.decode_any(b"P1\n2 1\n1 0\n").tolist() == [[0, 255]]
    assert images.decode_any(b"P4 9 1\n\x80\x80").tolist() == [[0] + [255] * 7 + [0]]


def test_pipeline_of_jpegs(spark, tmp_path):
    kinds = {"jpg": "jpg", "JPEG": "jpg", "bmp": "bmp", "tif": "tiff", "tiff": "tiff", "png": "png"}
    for i, (suffix, kind) in enumerate(kinds.items()):
        for k in range(2):
            path = tmp_path / "data" / "xy"[i % 2] / f"{'_' * k}{i}.{suffix}"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(written(spark, kind, picture(i)))
    (tmp_path / "data/x/broken.jpg").write_bytes(written(spark, "jpg", picture(0))[:60])
    config = {"dataset": {"train_root": f"{tmp_path}/data"}, "output_dir": str(tmp_path / "out"), "dedup": {}, "split": {"ratios": {"train": 0.7, "val": 0.15, "test": 0.15}, "index_dir": "splits"}}
    assert pipeline.run(spark, config)
    meta = json.loads((tmp_path / "out/splits.meta.json").read_text())
    assert (meta["images_scanned"], meta["images_dropped"], meta["images_kept"]) == (13, 1, 12)
    assert read_index(spark, f"{tmp_path}/out/splits").count() == 12


def test_no_decoder_ends_the_run(spark):
    try:
        import PIL  # noqa: F401
    except ImportError:
        rows = spark.createDataFrame([(1, bytearray(b"RIFF\x10\0\0\0WEBPVP8 " + bytes(8)))], "id long, content binary")
        with pytest.raises(Exception, match="WebP is read by Pillow only"):
            fingerprint.image_fingerprint(rows, "id", images.decode_gray).collect()
        with pytest.raises(Exception, match="WebP is read by Pillow only"):
            images.eval_tensors(rows, "id").collect()
