"""Quality by compression: which of two zstandard dictionaries suits a text better.

One dictionary is trained on texts labelled good, one on texts labelled bad, from all blocks
of a bounded sample of labelled rows (``SAMPLE`` rows and ``SAMPLE_BYTES`` of each label).
A text is compressed whole, block by block (so that a dictionary helps throughout a long
text), once with each.  The difference of the sizes, normalised by the size of the text and
by the compressed sizes, and the rate of compression go through a logistic curve, which is
fitted on sampled rows that the dictionaries didn't see; it gives the probability of label 1.

Null and empty texts get the score of a text of size 0; null ids and repeated rows stay rows
of their own; an empty table gives an empty result; without rows of both labels every score
is the share of label 1.  Other columns pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigram.llm.common import labelled_sample, slices, text_buffer

#: Labelled rows of each label that the model is fitted on at most, and bytes of their texts.
SAMPLE, SAMPLE_BYTES = 2000, 8 << 20
#: Bytes of a block, bytes of a dictionary, compression level.
BLOCK, DICTIONARY, LEVEL = 2000, 64_000, 3
THRESHOLD = 0.3


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)] or [b""]


def _own_lines(texts: list[bytes]) -> list[bytes]:
    """The texts without lines that another of them has too: passages that texts share say nothing of quality."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for line in set(t.split(b"\n")):
            seen[line] = seen.get(line, 0) + 1
    return [b"\n".join(line for line in t.split(b"\n") if seen[line] == 1) for t in texts]


def dictionary(samples: list[bytes]) -> bytes:
    """Trained where there is enough to train on, otherwise the samples themselves."""
    import zstandard

    size = min(DICTIONARY, max(256, sum(map(len, samples)) // 8))
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)  # only a few blocks


@dataclass
class Model:
    good: bytes
    bad: bytes
    curve: np.ndarray
    share: float
    _compressors: list = field(default_factory=list, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_compressors": []}

    def compressors(self) -> list:
        if not self._compressors:
            import zstandard as z

            params = z.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, format=z.FORMAT_ZSTD1_MAGICLESS)
            self._compressors = [z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d), compression_params=params) for d in (self.good, self.bad)]
        return self._compressors

    def sizes(self, texts: list[bytes]) -> np.ndarray:
        """Size of each text and its sizes by the good and the bad dictionary."""
        good, bad = (c.compress for c in self.compressors())
        out = np.empty((len(texts), 3))
        for i, t in enumerate(texts):
            parts = blocks(t)
            out[i] = len(t), sum(len(good(b)) for b in parts), sum(len(bad(b)) for b in parts)
        return out

    @staticmethod
    def features(sizes: np.ndarray) -> np.ndarray:
        n, good, bad = sizes.T
        return np.stack([20 * (bad - good) / (n + 20), 10 * (bad - good) / (good + bad + 20), np.log((np.minimum(good, bad) + 10) / (n + 20))], 1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not len(self.curve):
            return np.full(len(texts), self.share)
        x = self.features(self.sizes(texts))
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[:-1] + self.curve[-1], -30, 30)))


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last coefficient is the constant."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * np.r_[w[:-1], 0])
        w = w + np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return w


def fit(texts: list[bytes], good: np.ndarray, share: float) -> Model:
    """A model from labelled texts; ``share`` is that of label 1 among all labelled rows."""
    good = np.asarray(good, bool)
    part = np.arange(len(texts)) % 3  # two thirds for the dictionaries, one for the curve
    own = _own_lines(texts)
    samples = [[b for i, t in enumerate(own) if good[i] == k and part[i] < 2 for b in blocks(t) if b] for k in (True, False)]
    rest = part == 2
    if not all(samples) or not good[rest].any() or good[rest].all():
        return Model(b"", b"", np.zeros(0), share)
    model = Model(*map(dictionary, samples), np.zeros(4), share)
    y = good[rest]
    x = model.features(model.sizes([t for t, r in zip(texts, rest.tolist(), strict=True) if r]))
    model.curve = _curve(x, y.astype(float), np.where(y, share / y.mean(), (1 - share) / (1 - y.mean())))
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits on at most ``sample`` rows of each label, those with the least hashes of the id (see ``labelled_sample``)."""
    texts, y, share = labelled_sample(docs, labels, sample, SAMPLE_BYTES, id_col, text_col, label_col)
    if share is None:
        return Model(b"", b"", np.zeros(0), 0.5)
    return fit([t.encode() for t in texts], y == 1, share)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for part in slices(batches):
            buf, at = text_buffer(part.column(1))
            raw = buf.tobytes()
            texts = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(texts))], ["doc_id", "score"])

    return read.mapInArrow(run, f"doc_id {kind}, score double")
