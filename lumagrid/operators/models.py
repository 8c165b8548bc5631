"""A slot for recognition models that come from outside, as ONNX files on a path that all executors can read."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from lumagrid.operators.kernels import map_images


@lru_cache(2)
def session(path: str):
    """One session for each worker process and model."""
    import os

    if not os.path.exists(path):
        raise FileNotFoundError(f"no model weights at {path}: handwriting and semantic classes need a model that is supplied")
    import onnxruntime

    return onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])


def run_model(images: DataFrame, path: str) -> DataFrame:
    """image_id, output: the model's first output for each image as float32 (1, 1, h, w) in 0..1."""

    def apply(a: np.ndarray) -> dict:
        s = session(path)
        return {"output": s.run(None, {s.get_inputs()[0].name: (a[None, None] / 255).astype(np.float32)})[0].ravel().astype(float)}

    return map_images(images, apply, "output array<double>")
