"""Declared schemas of the tables that stages exchange."""

from __future__ import annotations

#: Source metadata as it arrives: text columns only, other columns pass through.
METADATA = "url STRING, date STRING, title STRING, categories STRING"
SAMPLED = METADATA + ", year INT"
ACQUISITION = SAMPLED + ", thumbnail_url STRING, thumbnail_path STRING, thumbnail_success BOOLEAN"
LISTING = "path STRING, length BIGINT, width INT, height INT"
MODEL_TEXT = "image_id STRING, raw STRING"
ANNOTATION_LOG = "image_id STRING, title STRING, thumbnail_path STRING, timestamp DOUBLE, model STRING, success BOOLEAN, annotation STRING, raw_output STRING, request_seconds DOUBLE"
VECTORS = "run_id STRING, image_id STRING, embedding ARRAY<FLOAT>"
PATCHES = "image_id STRING, grid_shape STRUCT<h: INT, w: INT>, patch_size INT, patches ARRAY<STRUCT<row: INT, col: INT, vec: ARRAY<FLOAT>>>"
ASSIGNMENTS = "image_id STRING, cluster_id INT, cluster_probability DOUBLE, umap_x DOUBLE, umap_y DOUBLE"
PATCH_ASSIGNMENTS = "image_id STRING, patch_row INT, patch_col INT, motif_id INT, motif_probability DOUBLE, umap_x DOUBLE, umap_y DOUBLE, thumbnail_path STRING"
RUNS = "run_id STRING, kind STRING, finished_at TIMESTAMP, partial BOOLEAN, ok BIGINT, failed BIGINT, params MAP<STRING,STRING>, detail STRING"

#: Vector length of known models (fixed values).
MODEL_DIMENSIONS = {"vitb16": 768, "vitl16": 1024}
