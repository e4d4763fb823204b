"""Pictures, by the pixels of the files."""

import glob
import io
import os
import struct
import zlib

import numpy as np

from loomcorpus import pictures


def stored(image):
    out = io.BytesIO()
    np.save(out, image)
    return out.getvalue() + b"\0" * 5000


def decoder(data):
    return np.load(io.BytesIO(data))


def pixels(data):
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, raw, size = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        raw += body if kind == b"IDAT" else b""
        at += 12 + n
    w, h = size
    return np.frombuffer(zlib.decompress(raw), np.uint8).reshape(h, 1 + 3 * w)[:, 1:].reshape(h, w, 3)


def test_files(spark, tmp_path):
    wide = {f"d/{k}.jpg": np.full((360, 640, 3), 20 * k, np.uint8) for k in range(5)}
    contents = spark.createDataFrame([*[(p, stored(x)) for p, x in wide.items()], ("d/bad.jpg", b"no picture" * 1000)], "path string, content binary")
    chosen = spark.createDataFrame([(0, 1, "d/1.jpg"), (0, 2, "d/2.jpg"), (-1, 1, "d/3.jpg"), (-1, 2, "d/bad.jpg")], "cluster_id int, rank int, thumbnail_path string")
    assert pictures.write(pictures.grids(chosen, contents, "cluster_id", decoder=decoder), str(tmp_path / "g")) == 2
    found = {os.path.basename(f): pixels(open(f, "rb").read()) for f in glob.glob(f"{tmp_path}/g/*")}
    assert set(found) == {"0.png", "noise.png"} and found["0.png"].shape == (90, 320, 3) and found["noise.png"].shape == (90, 160, 3)
    assert (found["0.png"][:, :160] == 20).all() and (found["0.png"][:, 160:] == 40).all()

    cells = spark.createDataFrame([(7, 1, "d/4.jpg", 6, 3), (7, 2, "d/4.jpg", 0, 0)], "motif_id int, rank int, thumbnail_path string, patch_row int, patch_col int")
    made = pixels(bytes(pictures.montages(cells, contents, "motif_id", decoder=decoder).first()["content"]))
    # the second cell lies in the padding
    assert made.shape == (128, 256, 3) and (made[:, :128] == 80).all() and not made[:, 128:].any()

    links = spark.createDataFrame([(7, "4.jpg", "d/4.jpg", 6, 3, 0.25), (7, "1.jpg", "d/1.jpg", None, 3, 0.5)], "motif_id int, image_id string, thumbnail_path string, best_patch_row int, best_patch_col int, patch_fraction double")
    rows = pictures.highlights(links, contents, decoder=decoder).collect()
    assert [r.name for r in rows] == ["7/4_0.250.png"]
    made = pixels(bytes(rows[0].content))
    assert (made[96, 48] == (255, 0, 0)).all() and (made[104, 56] == 80).all() and not made[0].any()

    seen = pictures.previews(contents, (32,), decoder=decoder).collect()
    assert sorted(r.name for r in seen if r.name) == [f"{k}_32.png" for k in range(5)] and sum(r.reason != "ok" for r in seen) == 1


def test_preview_command(spark, tmp_path):
    from loomcorpus import cli

    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.jpg").write_bytes(stored(np.full((360, 640, 3), 50, np.uint8)))
    done = cli.main(["preview", "--folder", f"file://{tmp_path}/in", "--limit", "2", "--include-placeholders", "--output", f"{tmp_path}/out", "--decoder", "tests.core.test_pictures:decoder"])
    assert len(done["pictures"]) == 2 and done["written"] == 4 and len(glob.glob(f"{tmp_path}/out/*.png")) == 4
