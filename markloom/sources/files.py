"""Uploaded files and page images as tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markloom.operators.intake import extension

LEAST_SIDE = 80


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """file_name, extension, byte_size, is_pdf of the files under a path; a file is a PDF by its extension or where
    ``%PDF-`` stands among its first 1,024 bytes."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    head = F.decode(F.substring("content", 1, 1024), "ISO-8859-1")
    return files.select(
        name.alias("file_name"), extension(name).alias("extension"), F.col("length").alias("byte_size"),
        ((extension(name) == ".pdf") | (F.instr(head, "%PDF-") > 0)).alias("is_pdf"),
    )


def scan_page_rasters(spark: SparkSession, path: str) -> DataFrame:
    """file_name, width, height, gray (row-major bytes), error of the images under a path. Images that cannot be read,
    and those under 80 pixels on a side, have the error CORRUPT or TOO_SMALL and no pixels."""

    def to_gray(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            gray, error = [], []
            for w, h, n, data in zip(pdf["width"], pdf["height"], pdf["nChannels"], pdf["data"], strict=True):
                bad = "CORRUPT" if w < 1 or h < 1 else "TOO_SMALL" if min(w, h) < LEAST_SIDE else None
                error.append(bad)
                if bad:
                    gray.append(None)
                    continue
                px = np.frombuffer(data, np.uint8).reshape(h, w, n)
                mixed = px[..., 0] if n == 1 else px[..., :3] @ np.array([0.114, 0.587, 0.299])  # blue, green, red
                gray.append(np.clip(np.rint(mixed), 0, 255).astype(np.uint8).tobytes())
            yield pd.DataFrame({"file_name": pdf["file_name"], "width": pdf["width"], "height": pdf["height"], "gray": gray, "error": error})

    images = spark.read.format("image").option("dropInvalid", False).load(path)
    named = images.select(F.element_at(F.split("image.origin", "/"), -1).alias("file_name"), "image.width", "image.height", "image.nChannels", "image.data")
    return named.mapInPandas(to_gray, "file_name string, width int, height int, gray binary, error string")
