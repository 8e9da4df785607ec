import struct
import zlib

import pytest

from kelpwork.operators import fingerprint, images, scan
from kelpwork.sources.images import binary_images, scan_dataset, scan_folder, with_content


def png(pixels):
    raw = b"".join(b"\0" + bytes(row) for row in pixels)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    header = struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def picture(k):
    return [[(x * (k + 3) + y * (7 - k) * 2 + x * y) % 256 for x in range(40)] for y in range(36)]


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    files = {"al/a.PNG": png(picture(0)), "al/b c%.png": png(picture(1)), "al/_u.png": png(picture(0)), "al/.h.png": png(picture(2)), "zay/z.png": png(picture(3)), "zay/deep/q.png": png(picture(1)), "zay/bad.png": b"garbage", "zay/p.ppm": b"P6\n2 2\n255\n" + bytes(12), "zay/n.txt": b"x"}
    for name, data in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    (root / "empty").mkdir()
    return str(root)


def test_scan_dataset(spark, tree):
    rows, info = scan_dataset(spark, tree)
    assert [(r.row_idx, r.image_path) for r in rows.orderBy("row_idx").collect()] == list(enumerate(["al/.h.png", "al/_u.png", "al/a.PNG", "al/b c%.png", "zay/bad.png", "zay/p.ppm", "zay/z.png"]))
    assert info["subdirs"] == ["al", "empty", "zay"] and info["missing_classes"] == []
    rows, info = scan_dataset(spark, tree, ["zay", "nope", "al"])
    assert [r.label for r in rows.orderBy("row_idx").collect()] == ["zay"] * 3 + ["al"] * 4
    assert info["missing_classes"] == ["nope"] and info["extra_folders"] == ["empty"]
    with pytest.raises(FileNotFoundError):
        scan_dataset(spark, tree + "-none")


def test_fingerprints_and_drops(spark, tree):
    rows, _ = scan_dataset(spark, tree)
    prints = fingerprint.image_fingerprint(with_content(rows.select("image_path", "path")), "image_path", images.decode_gray)
    held = {r.image_path: r.fp for r in prints.collect()}
    assert held["zay/bad.png"] is None and held["al/a.PNG"] == held["al/_u.png"] != held["al/b c%.png"]
    assert all(len(v) == 32 for v in held.values() if v is not None)
    assert tuple(fingerprint.n_dropped(prints).first()) == (7, 1, 6)


def test_spark_source_sees_no_hidden_names(spark, tree):
    names = {r.path.rsplit("/", 1)[1] for r in binary_images(spark, tree).select("path").collect()}
    assert names == {"a.PNG", "b c%.png", "z.png", "bad.png", "p.ppm", "n.txt"}


def test_flat_folder(spark, tmp_path):
    for n in ("AL.png", "aleff12.png", "haa_3.png", "ha1.png", "zzz.png"):
        (tmp_path / n).write_bytes(b"")
    got = {r.image_path.rsplit("/", 1)[1]: r.label for r in scan_folder(spark, str(tmp_path), ["al", "aleff", "ha", "haa"]).collect()}
    assert got == {"AL.png": "al", "aleff12.png": "aleff", "haa_3.png": "haa", "ha1.png": "ha"}


def test_extensions(spark):
    df = spark.createDataFrame([(n,) for n in ("a.JPG", "b.txt", ".png", ".h.png", "c.tar.webp", "d", None)], "path string")
    assert {r.path for r in scan.images_only(df).collect()} == {"a.JPG", ".h.png", "c.tar.webp"}


def test_class_differences(spark):
    df = spark.createDataFrame([("y",), ("z",), ("y",), (None,)], "label string")
    assert sorted(tuple(r) for r in scan.class_differences(df, "label", ["x", "y"]).collect()) == [("extra", "z", 0), ("missing", "x", 0)]


def test_transforms(spark, tree):
    rows, _ = scan_dataset(spark, tree)
    content = with_content(rows.select("image_path", "path"))
    out = {r.image_path: r.tensor for r in images.eval_tensors(content, "image_path", size=32).collect()}
    assert out["zay/bad.png"] is None and len(out["al/a.PNG"]) == 3 * 32 * 32
    once = images.train_tensors(content, "image_path", seed=1, size=16).collect()
    again = images.train_tensors(content.repartition(3), "image_path", seed=1, size=16).collect()
    assert {r.image_path: r.tensor for r in once} == {r.image_path: r.tensor for r in again}
