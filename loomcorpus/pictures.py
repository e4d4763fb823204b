"""Pictures of a run: grids of samples, montages of cells, highlighted cells, previews.

What is drawn is chosen by the table operators; contents come as a table of (path, content), as
Spark reads binary files, and are drawn where they lie, a group or a picture at a time. Results
are (name, content) rows of PNG files. A picture that cannot be read is left out of its grid.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcorpus.functions.text import group_label, stem
from loomcorpus.operators import images, layout

FILE = "name string, content binary"


def _decoded(data: bytes, decoder: Callable | None) -> np.ndarray | None:
    try:
        return images.decode(data, decoder)
    except Exception:  # noqa: BLE001
        return None


def grids(chosen: DataFrame, contents: DataFrame, group: str, path: str = "thumbnail_path", decoder: Callable | None = None, height: int = 90, columns: int = 4) -> DataFrame:
    """A grid of each group's ranked pictures; noise is a group named so."""

    def draw(part: pd.DataFrame) -> pd.DataFrame:
        found = [p for p in (_decoded(c, decoder) for c in part.sort_values("rank")["content"]) if p is not None]
        return pd.DataFrame({"name": [f"{part['label'].iloc[0]}.png"], "content": [images.png(images.grid(found, height, columns))]})

    rows = chosen.join(contents.select(F.col("path").alias(path), "content"), path).select(group_label(F.col(group)).alias("label"), "rank", "content")
    return rows.groupBy("label").applyInPandas(draw, FILE)


def montages(cells: DataFrame, contents: DataFrame, group: str, path: str = "thumbnail_path", decoder: Callable | None = None, target: int = 224, patch: int = 16, upscale: int = 8, columns: int = 4) -> DataFrame:
    """A grid of each group's ranked cells, cut from their letterboxed pictures and enlarged."""

    def draw(part: pd.DataFrame) -> pd.DataFrame:
        found = []
        for r in part.sort_values("rank").itertuples():
            picture = _decoded(r.content, decoder)
            if picture is not None:
                square = images.resize(images.letterbox(picture)[0], target, target)
                found.append(images.crop_cell(square, r.patch_row, r.patch_col, patch, upscale))
        return pd.DataFrame({"name": [f"{part['label'].iloc[0]}.png"], "content": [images.png(images.grid(found, patch * upscale, columns))]})

    rows = cells.join(contents.select(F.col("path").alias(path), "content"), path).select(group_label(F.col(group)).alias("label"), "rank", "patch_row", "patch_col", "content")
    return rows.groupBy("label").applyInPandas(draw, FILE)


def highlights(links: DataFrame, contents: DataFrame, group: str = "motif_id", path: str = "thumbnail_path", decoder: Callable | None = None, target: int = 224, patch: int = 16) -> DataFrame:
    """Every picture with its best cell framed, named by group, item and share; rows without a cell are left out."""

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples():
                picture = _decoded(r.content, decoder)
                if picture is not None:
                    square = images.resize(images.letterbox(picture)[0], target, target)
                    out.append((r.name, images.png(images.box(square, r.x0, r.y0, r.x1, r.y1))))
            yield pd.DataFrame(out, columns=["name", "content"])

    named = F.concat(group_label(F.col(group)), F.lit("/"), layout.preview_name(stem(F.col("image_id")), F.col("patch_fraction")))
    rows = links.dropna(subset=["best_patch_row", "best_patch_col"]).join(contents.select(F.col("path").alias(path), "content"), path)
    rows = rows.select(F.regexp_replace(named, r"\.jpg$", ".png").alias("name"), "content", *layout.cell_box(F.col("best_patch_row"), F.col("best_patch_col"), patch))
    return rows.mapInPandas(draw, FILE)


def previews(contents: DataFrame, sizes: tuple[int, ...] = (224, 518), min_bytes: int = 4096, size: tuple[int, int] = (640, 360), decoder: Callable | None = None) -> DataFrame:
    """(path, target, name, content, reason): pictures as a model gets them, or why there is none."""

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, data in zip(part["path"], part["content"], strict=True):
                for target in sizes:
                    try:
                        made = images.preprocess(data, target, min_bytes, size, decoder)["image"]
                        out.append((path, target, f"{path.rsplit('/', 1)[-1].rsplit('.', 1)[0]}_{target}.png", images.png(made), "ok"))
                    except Exception as e:  # noqa: BLE001
                        out.append((path, target, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "target", "name", "content", "reason"])

    return contents.select("path", "content").mapInPandas(draw, "path string, target int, name string, content binary, reason string")


def write(files: DataFrame, folder: str) -> int:
    """Writes (name, content) rows as files below a folder that all executors share; how many there are."""

    def put(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for part in parts:
            for name, content in zip(part["name"], part["content"], strict=True):
                at = os.path.join(folder, name)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(at, "wb") as f:
                    f.write(content)
            yield pd.DataFrame({"n": [len(part)]})

    return files.where("content is not null").select("name", "content").mapInPandas(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
