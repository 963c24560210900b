"""Quality classifier by compression: how much better a text packs with a dictionary of good texts than with one of bad texts.

Two zstandard dictionaries are built from labelled texts, one for each label.  A text is cut in pieces, every piece is packed
with both dictionaries, and the difference of the summed sizes for each byte of text is turned into a probability by a logistic
curve that is fitted on other labelled texts than those in the dictionaries: the score depends on nothing else.

Training rows are a bounded sample: the SAMPLE_ROWS smallest by hash of their id for each label, among labelled texts of at
most SAMPLE_CHARS characters.  Scoring reads whole texts.

Edge cases: a null text counts as empty; an empty text gets the fitted curve's value at no difference; several labels for
one id count as the smallest; null labels and ids are left out; with no rows of some label every score is the share of label 1
(0.5 without any rows); repeated rows are scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import col, map_texts

#: Labelled texts of each label that the classifier is fitted on, and the longest text that is taken for it.
SAMPLE_ROWS, SAMPLE_CHARS = 1500, 20_000
#: Bytes of a dictionary, bytes of a piece of text, and the compression level.
DICTIONARY_BYTES, PIECE_BYTES, LEVEL = 96 << 10, 512, 3
#: Bytes that are added to the size of every text, so that short texts say little.
PRIOR_BYTES = 128


def _pieces(raw: bytes) -> list[bytes]:
    return [raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]


def build_dictionary(texts: list[bytes]) -> bytes:
    """A zstandard dictionary for texts; the texts' own bytes where there are too few to train one."""
    pieces = [p for t in texts for p in _pieces(t) if len(p) >= 16]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[-DICTIONARY_BYTES:] or b"\n" * 16


class _Packer:
    """Packed sizes under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.by_label = []
        for d in (bad, good):
            trained = d[:4] == b"\x37\xa4\x30\xec"
            dictionary = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=LEVEL)
            self.by_label.append(zstandard.ZstdCompressor(dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False))

    def difference(self, text: str | None) -> float:
        """Bytes that the dictionary of good texts saves against that of bad ones, for each byte of text."""
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        pieces = _pieces(raw)
        bad, good = (sum(len(c.compress(p)) for p in pieces) for c in self.by_label)
        return (bad - good) / (len(raw) + PRIOR_BYTES)


def _terms(difference: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(difference)), difference * 20], axis=1)


def fit_logistic(difference: np.ndarray, y: np.ndarray, share: float, ridge: float = 1e-2, rounds: int = 100) -> np.ndarray:
    """Intercept and slope by Newton's method, steps halved until the loss falls; label 1 weighs ``share`` of all rows, as it does among all labels."""
    t = _terms(difference)
    weight = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))

    def loss(w: np.ndarray) -> float:
        z = t @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + ridge * (w @ w) / 2)

    w = np.zeros(t.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(t @ w, -30, 30)))
        gradient = t.T @ (weight * (y - p)) - ridge * w
        hessian = (t * (weight * p * (1 - p))[:, None]).T @ t + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        while loss(w + step) > loss(w) and np.abs(step).max() >= 1e-8:
            step /= 2
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    weights: np.ndarray | None
    constant: float = 0.5

    def packer(self) -> _Packer:
        return _Packer(self.good, self.bad)

    def scores(self, difference: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(difference), self.constant)
        return 1 / (1 + np.exp(-np.clip(_terms(difference) @ self.weights, -30, 30)))


def fit(rows: list[tuple[str, int]], share: float | None = None) -> CompressionModel:
    """From (text, label): every other text of a label goes in its dictionary, the rest calibrates.

    ``share`` is that of label 1 among all labelled rows, which the scores are calibrated to.
    """
    by_label = [[t for t, y in rows if y == label] for label in (0, 1)]
    if min(map(len, by_label)) < 2:
        n = sum(map(len, by_label))
        return CompressionModel(b"", b"", None, len(by_label[1]) / n if n else 0.5)
    bad, good = (build_dictionary([t.encode("utf-8", "surrogatepass") for t in texts[::2]]) for texts in by_label)
    packer = _Packer(good, bad)
    x = np.array([packer.difference(t) for texts in by_label for t in texts[1::2]])
    y = np.array([label for label in (0, 1) for _ in by_label[label][1::2]], float)
    share = y.mean() if share is None else min(max(share, 0.01), 0.99)
    return CompressionModel(good, bad, fit_logistic(x, y, share))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def known_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """``i, y``: one label for each id that may be learned from."""
    known = labels.select(col(id_col).alias("i"), col(label_col).alias("y")).where("i IS NOT NULL AND y IS NOT NULL").groupBy("i").agg(F.min("y").cast("int").alias("y"))
    return known.where(~held_out(F.col("i")) & F.col("y").isin(0, 1))


def training_rows(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, sample: int) -> list[tuple[str, int]]:
    """The bounded sample, in order of the hash."""
    order = lambda c: F.struct(F.xxhash64(F.col(c)), F.col(c))
    out: list[tuple[str, int]] = []
    for label in (0, 1):
        # half as many again, as some labelled texts are too long or missing
        ids = known.where(F.col("y") == label).orderBy(order("i")).limit(sample + sample // 2)
        texts = docs.select(col(id_col).alias("d"), col(text_col).alias("t")).where(F.length("t").between(1, SAMPLE_CHARS))
        rows = texts.join(F.broadcast(ids), F.col("d") == F.col("i")).orderBy(order("d"), "t").limit(sample).select("t").collect()
        out += [(r["t"], label) for r in rows]
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_ROWS) -> CompressionModel:
    known = known_labels(labels, id_col, label_col)
    share = known.agg(F.avg("y")).first()[0]
    return fit(training_rows(docs, known, id_col, text_col, sample), share)


def score(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, held_out, score, predicted, difference``."""

    def make():
        packer = model.packer() if model.weights is not None else None

        def run(texts: list[str | None]) -> tuple[np.ndarray, ...]:
            x = np.array([packer.difference(t) if packer else 0.0 for t in texts], float)
            s = model.scores(x)
            return s, (s >= 0.5).astype("int32"), x

        return run

    slim = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    return map_texts(slim, "text", make, "score double, predicted int, difference double", ["doc_id", "held_out"])
