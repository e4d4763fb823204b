"""Work that a caller's function does for every row: fetching, inference, annotation.

The function is handed in; nothing here reaches a network or a model. It is made once per task
by a factory, and an exception becomes a row that says so, never the end of the run.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FETCHED = "url string, key string, thumbnail_url string, content binary, success boolean, error string"
ANNOTATED = "image_id string, raw_output string, success boolean, request_error boolean, request_seconds double"
EMBEDDED = "image_id string, embedding array<float>, ok boolean, error string, seconds double"
PATCHED = "image_id string, grid_shape struct<h:int,w:int>, patch_size int, patches array<struct<row:int,col:int,vec:array<float>>>, ok boolean, error string, seconds double"


def fetch(rows: DataFrame, factory: Callable[[], Callable[[str], tuple[int, str, bytes]]], page_image: Callable[[bytes], str | None], template: str = "{a}/{b}/{c}/{key}", delay: float = 0.0) -> DataFrame:
    """Two ways to an image for each (url, key): a URL built from the key, else the page's own.

    ``factory()`` gives a function url -> (status, content type, body). delay: seconds that a task
    rests after each row.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = factory()

        def usable(url: str) -> bytes | None:
            status, kind, body = get(url)
            return body if status == 200 and "image" in (kind or "").lower() else None

        for part in parts:
            out = []
            for url, key in zip(part["url"], part["key"], strict=True):
                found, where, error = None, None, None
                if not key:
                    error = "no key"
                else:
                    try:
                        where = template.format(a=key[:3], b=key[3:6], c=key[6:9], key=key)
                        found = usable(where)
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                    if found is None:
                        try:
                            status, _, body = get(url)
                            where = page_image(body) if status == 200 else None
                            found = usable(where) if where else None
                            error = None if found is not None else (error or "no image")
                        except Exception as e:  # noqa: BLE001
                            error = f"{type(e).__name__}: {e}"
                out.append((url, key, where if found is not None else None, found, found is not None, error))
                time.sleep(delay if key else 0)
            yield pd.DataFrame(out, columns=["url", "key", "thumbnail_url", "content", "success", "error"])

    return rows.select("url", "key").mapInPandas(run, FETCHED)


def annotate(rows: DataFrame, factory: Callable[[], Callable[[str, str, str], str]], prompt: str) -> DataFrame:
    """Answers of ``factory()(prompt, image_id, title)`` with times; errors are kept as text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = factory()
        for part in parts:
            out = []
            for ident, title in zip(part["image_id"], part["title"], strict=True):
                began = time.perf_counter()
                try:
                    raw, failed = ask(prompt, ident, title or ""), False
                except Exception as e:  # noqa: BLE001
                    raw, failed = f"REQUEST_ERROR: {e}", True
                out.append((ident, raw, not failed, failed, round(time.perf_counter() - began, 3)))
            yield pd.DataFrame(out, columns=["image_id", "raw_output", "success", "request_error", "request_seconds"])

    return rows.select("image_id", "title").mapInPandas(run, ANNOTATED)


def embed(rows: DataFrame, factory: Callable[[], Callable[[str], list[float]]], source: str = "usable_path") -> DataFrame:
    """One vector per row from ``factory()(path)``; a failed row has none and says why."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for part in parts:
            out = []
            for ident, path in zip(part["image_id"], part["__source"], strict=True):
                began = time.perf_counter()
                try:
                    vec, error = [float(x) for x in model(path)], None
                except Exception as e:  # noqa: BLE001
                    vec, error = None, f"{type(e).__name__}: {e}"
                out.append((ident, vec, error is None, error, time.perf_counter() - began))
            yield pd.DataFrame(out, columns=["image_id", "embedding", "ok", "error", "seconds"])

    return rows.select("image_id", F.col(source).alias("__source")).mapInPandas(run, EMBEDDED)


def patch_vectors(tokens, grid: tuple[int, int], content_rows: list[int], skip: int = 1) -> list[tuple[int, int, list[float]]]:
    """Cells of a token matrix without its first ``skip`` tokens, outside the padding rows.

    Wrong counts and pictures that are all padding are errors.
    """
    h, w = grid
    cells = tokens[skip:]
    if len(cells) != h * w:
        raise ValueError(f"{len(cells)} cells for a grid of {h} by {w}")
    keep = set(content_rows)
    out = [(r, c, [float(x) for x in cells[r * w + c]]) for r in range(h) if r in keep for c in range(w)]
    if not out:
        raise ValueError("no content cells")
    return out


def embed_patches(rows: DataFrame, factory: Callable[[], Callable[[str], tuple]], source: str = "usable_path", patch_size: int = 16, skip: int = 1) -> DataFrame:
    """Nested cell vectors; ``factory()(path)`` gives (tokens, (grid h, grid w), content rows)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for part in parts:
            out = []
            for ident, path in zip(part["image_id"], part["__source"], strict=True):
                began = time.perf_counter()
                try:
                    tokens, grid, content = model(path)
                    cells = [{"row": r, "col": c, "vec": v} for r, c, v in patch_vectors(tokens, grid, content, skip)]
                    out.append((ident, {"h": grid[0], "w": grid[1]}, patch_size, cells, True, None, time.perf_counter() - began))
                except Exception as e:  # noqa: BLE001
                    out.append((ident, None, patch_size, None, False, f"{type(e).__name__}: {e}", time.perf_counter() - began))
            yield pd.DataFrame(out, columns=["image_id", "grid_shape", "patch_size", "patches", "ok", "error", "seconds"])

    return rows.select("image_id", F.col(source).alias("__source")).mapInPandas(run, PATCHED)


def flat_patches(nested: DataFrame) -> DataFrame:
    """(image_id, patch_row, patch_col, vec): one row per cell."""
    cells = nested.select("image_id", F.inline("patches"))
    return cells.select("image_id", F.col("row").alias("patch_row"), F.col("col").alias("patch_col"), "vec")


def timing(df: DataFrame, load_seconds: float | None = None) -> DataFrame:
    """(images, ok, failed, load_seconds, infer_seconds, seconds_per_image) of an embedding run."""
    out = df.agg(F.count("*").alias("images"), F.count_if("ok").alias("ok"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("infer_seconds"))
    return out.select("images", "ok", (F.col("images") - F.col("ok")).alias("failed"), F.lit(load_seconds).cast("double").alias("load_seconds"), F.round("infer_seconds", 3).alias("infer_seconds"), F.round(F.try_divide("infer_seconds", F.col("ok").cast("double")), 4).alias("seconds_per_image"))
