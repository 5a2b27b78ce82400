"""Quality by compression: a text resembles the labelled texts whose dictionary makes it smaller.

Two zstandard dictionaries are trained, one from good and one from bad labelled texts. A text is compressed whole with
both. The difference of the sizes, normalised by the text's size and by the larger of both, is calibrated to a probability by a logistic
fit, linear on either side of no difference, on labelled rows that no dictionary was trained from. A second calibration, the rich one,
also sees the length and how far the text compresses at all, which tells repetition that either dictionary makes small.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from strandline.llm.common import labelled_rows


@dataclass(frozen=True)
class QualityParams:
    """Bounds of the labelled sample, which is all that reaches the driver."""

    rows_per_class: int = 6000  # half of them train the dictionary, half the calibration
    bytes_per_class: int = 24 << 20
    dictionary_bytes: int = 1 << 16
    level: int = 3
    seed: int = 6


@dataclass(frozen=True)
class QualityModel:
    bad: bytes
    good: bytes
    level: int
    scale: tuple[float, ...] = ()  # of the normalised differences
    coefficients: tuple[float, ...] = ()
    rich: tuple[float, ...] = ()


def compressors(model: QualityModel) -> list[zstandard.ZstdCompressor]:
    out = []
    for data in (model.bad, model.good):
        dictionary = zstandard.ZstdCompressionDict(data)
        dictionary.precompute_compress(level=model.level)
        out.append(zstandard.ZstdCompressor(dict_data=dictionary, level=model.level, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def sizes(texts: list[str | None], with_bad: zstandard.ZstdCompressor, with_good: zstandard.ZstdCompressor) -> np.ndarray:
    """A row per text: difference per byte, difference over the larger size, log of the length, size per byte with the good dictionary."""
    rows = np.zeros((len(texts), 4))
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if raw:
            a, b = len(with_bad.compress(raw)), len(with_good.compress(raw))
            rows[i] = (a - b) / len(raw), (a - b) / max(a, b), np.log(len(raw)), b / len(raw)
    return rows


def difference_inputs(rows: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """1, both normalised differences and their amounts, each up to four of its spreads."""
    d = np.clip(rows[:, :2] / scale, -4, 4)
    return np.column_stack([np.ones(len(rows)), d, np.abs(d)])


def rich_inputs(rows: np.ndarray) -> np.ndarray:
    d, e, n, r = rows.T
    return np.column_stack([np.ones(len(rows)), d, e, n / 8, d * n / 8, e * n / 8, r, r * r])


def probability(x: np.ndarray, coefficients: tuple[float, ...]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ np.array(coefficients), -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weights * (p - y)) + ridge * w
        hess = (x * (weights * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", params: QualityParams = QualityParams()) -> QualityModel:
    """The model from docs with labels 0 (bad) and 1 (good) of that id; other labels don't count. Of ids labelled twice the higher
    label counts. Without labelled texts of both classes every score is 0.5. Rows that repeat an id are each a text of the sample."""
    drawn, totals = labelled_rows(docs, labels, id_col, text_col, label_col, params.rows_per_class, params.bytes_per_class, params.seed)
    rows = drawn.orderBy("y", "_upto").collect()
    trained, rest = {0: [], 1: []}, []
    for y in (0, 1):
        own = [r["text"].encode("utf-8", "surrogatepass") for r in rows if r["y"] == y]
        for i, text in enumerate(own):
            # Every other row, so that both parts have texts of all lengths.
            if i % 2 == 0:
                trained[y].append(text)
            else:
                rest.append((y, text))
    if not all(trained.values()) or len({y for y, _ in rest}) < 2:
        return QualityModel(b"", b"", params.level)
    raw = []
    for y in (0, 1):
        try:
            raw.append(zstandard.train_dictionary(params.dictionary_bytes, trained[y], level=params.level).as_bytes())
        except zstandard.ZstdError:  # too little text to train from: the texts themselves
            raw.append(b"\n".join(trained[y])[-params.dictionary_bytes :])
    model = QualityModel(raw[0], raw[1], params.level)
    y = np.array([y for y, _ in rest])
    measured = sizes([t.decode("utf-8", "surrogatepass") for _, t in rest], *compressors(model))
    scale = np.maximum(measured[:, :2].std(axis=0), 1e-9)
    # The sample is drawn by class; weights bring back the shares of all labelled rows.
    weights = np.where(y == 1, totals[1] / (y == 1).sum(), totals[0] / (y == 0).sum())
    weights *= len(y) / weights.sum()
    own = logistic(difference_inputs(measured, scale), y, weights, ridge=1.0)
    return replace(model, scale=tuple(scale), coefficients=tuple(own), rich=tuple(logistic(rich_inputs(measured), y, weights)))


def scored(docs: DataFrame, model: QualityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the columns out, a double from 0 to 1, higher for likelier good, by the difference alone; rich_<out>, that of the rich
    calibration; and difference, per byte. Null or empty texts have no difference and no length. Columns of docs with these names are
    replaced, others stay; every row gives one row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own: list = []

    @pandas_udf("score double, rich double, difference double")
    def score(text: pd.Series) -> pd.DataFrame:
        m = shared.value
        if not m.bad:
            return pd.DataFrame({"score": np.full(len(text), 0.5), "rich": 0.5, "difference": 0.0})
        if not own:
            own.extend(compressors(m))
        rows = sizes(list(text), *own)
        return pd.DataFrame({"score": probability(difference_inputs(rows, np.array(m.scale)), m.coefficients), "rich": probability(rich_inputs(rows), m.rich), "difference": rows[:, 0]})

    names = {out: "score", f"rich_{out}": "rich", "difference": "difference"}
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in names), score(F.col(text_col)).alias("__scores"))
    return rows.select(*(F.col(f"`{c}`") for c in rows.columns[:-1]), *(F.col(f"__scores.{x}").alias(c) for c, x in names.items()))
