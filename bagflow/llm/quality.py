"""Quality classifier by compression: two zstandard dictionaries, one calibrated size difference.

A text compresses better with a dictionary of its own kind. The operator trains one dictionary on good and one on
bad labelled texts and scores a text by the difference of its two compressed sizes over their sum, each piece of 256 bytes
compressed on its own, so that dictionaries matter more than what a text repeats of itself and help the whole of a long
text alike. Logistic regression, fitted on labelled rows that trained neither dictionary, maps that difference, and
nothing else, to a probability.

Fitting reads a bounded sample (`per_class` rows of each label, of at most `train_chars` code points each; rows in
order of a hash of their id). Scoring reads every whole text.

Defined results: null or empty text scores what a difference of 0 scores; repeated rows score alike; an empty table
gives an empty result; with labels of one class only (or none) every score is that class's share (0.5 if none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import held_out, id_and_text

LEVEL = 3
CHUNK = 256
#: Bytes of a frame without any content, taken off every compressed size.
FRAME = 6
FOLDS = 5


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on the pieces of the samples; of raw content where they are too few to train on."""
    pieces = [s[i : i + 2 * CHUNK] for s in samples for i in range(0, len(s), 2 * CHUNK)]
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[-size:]


class _Sizer:
    """Compressed sizes of texts under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.packers = []
        for d in (good, bad):
            held = zstandard.ZstdCompressionDict(d) if d else None  # trained or raw by its first bytes
            if held:
                held.precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False))

    def difference(self, text: bytes) -> float:
        """The normalised size difference, above 0 if the good dictionary helps more; every byte counts."""
        g, b = (sum(len(p.compress(text[i : i + CHUNK])) - FRAME for i in range(0, len(text), CHUNK)) for p in self.packers)
        return (b - g) / max(1, b + g)


def _design(x: np.ndarray) -> np.ndarray:
    """Columns of the calibration: the difference and 1."""
    return np.stack([x, np.ones(len(x))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> list[float]:
    """Weights by Newton's method with a light ridge on scaled columns."""
    z = _design(x)
    scale = np.maximum(np.abs(z).max(axis=0), 1e-9)
    z = z / scale
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w)), z.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return [float(v) for v in w / scale]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = FOLDS,
    per_class: int = 2000,
    train_chars: int = 20_000,
    dict_bytes: int = 65_536,
) -> dict:
    """Fit on the rows outside the held-out fold. The sample of at most 2 * per_class short texts reaches the driver."""
    ids = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    ids = ids.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("doc_id", folds)).withColumn("order", F.xxhash64("doc_id"))
    texts = id_and_text(docs, id_col, text_col).filter((F.length("text") > 0) & (F.length("text") <= train_chars))
    sample = None
    for label in (0, 1):
        one = ids.filter(F.col("label") == label).dropDuplicates(["doc_id"]).orderBy("order", "doc_id").limit(per_class)
        sample = one if sample is None else sample.unionByName(one)
    rows = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label", "order").orderBy("order", "doc_id", "text").collect()
    by = {label: [r["text"].encode("utf-8", "replace") for r in rows if r["label"] == label] for label in (0, 1)}
    if not by[0] or not by[1]:
        share = 0.5 if not rows else float(bool(by[1]))
        return {"good": b"", "bad": b"", "weights": [0.0, float(np.log((share + 0.01) / (1.01 - share)))]}
    model = {"good": _dictionary(by[1][::2], dict_bytes), "bad": _dictionary(by[0][::2], dict_bytes)}
    sizer = _Sizer(model["good"], model["bad"])
    held = {label: by[label][1::2] or by[label] for label in by}
    x = np.array([sizer.difference(t) for label in (0, 1) for t in held[label]])
    y = np.array([label for label in (0, 1) for _ in held[label]], dtype=float)
    model["weights"] = _logistic(x, y)
    return model


def score(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: better) and the size difference behind it, for every row."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    df = id_and_text(docs, id_col, text_col)
    kind = df.schema["doc_id"].dataType.simpleString()

    def rows(batches):
        m = held.value
        sizer = _Sizer(m["good"], m["bad"])
        for b in batches:
            x = np.array([sizer.difference(t.encode("utf-8", "replace")) for t in b.column(1).to_pylist()], dtype=float)
            s = 1 / (1 + np.exp(-np.clip(_design(x) @ np.array(m["weights"]), -700, 700)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array(x)], names=["doc_id", "score", "size_difference"])

    return df.mapInArrow(rows, f"doc_id {kind}, score double, size_difference double")


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **options) -> DataFrame:
    """Fit on labels and score all docs: doc_id, held_out, score, predicted, size_difference."""
    model = fit(docs, labels, **options)
    out = score(docs, model, id_col=options.get("id_col", "doc_id"), text_col=options.get("text_col", "text"))
    return out.select(
        "doc_id",
        F.coalesce(held_out("doc_id", options.get("folds", FOLDS)), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "size_difference",
    )


def keep_good(docs: DataFrame, model: dict, *, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least threshold."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def rows(batches):
        m = held.value
        sizer = _Sizer(m["good"], m["bad"])
        for b in batches:
            x = np.array([sizer.difference((t or "").encode("utf-8", "replace")) for t in b.column(at).to_pylist()], dtype=float)
            s = 1 / (1 + np.exp(-np.clip(_design(x) @ np.array(m["weights"]), -700, 700)))
            yield b.filter(pa.array(s >= threshold))

    return docs.mapInArrow(rows, docs.schema)
