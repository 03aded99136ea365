"""Language identification by a string kernel.

The kernel is the blended-spectrum presence kernel: how many byte n-grams (1 to 4, lower-cased, white space
runs as one space) two texts share, divided by the root of the product of their numbers of n-grams.  N-grams are
hashed to FEATURES slots.  Nyström landmarks turn kernel values into features, one-versus-rest kernel ridge
regression is solved on them, and texts are scored in batches by two matrix products.

The model is fitted on a bounded sample (about per_language labelled rows of each language); every text is scored
whole.  The normal equations of the ridge regression are summed up in tasks: the driver sees the landmarks and
matrices of landmarks x landmarks, never the sample.  What is broadcast is max(LANDMARKS, languages) x FEATURES bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tesselar.llm.common import stored

FEATURES = 1 << 15
LANDMARKS = 64
ORDERS = 4
PER_LANGUAGE = 250
RIDGE = 1e-3
UNKNOWN = "und"
_WHITE = re.compile(rb"[\x09-\x0D\x20]+")


def has_letter(text: str) -> bool:
    """Whether a character is of a letter category; numerals such as Roman or circled ones are none."""
    return any(map(str.isalpha, text))


def presence(text: str) -> np.ndarray:
    """Which slots the text's n-grams take."""
    raw = np.frombuffer(_WHITE.sub(b" ", text.lower().encode("utf-8", "replace")), np.uint8)
    on = np.zeros(FEATURES, bool)
    for lo in range(0, len(raw), 1 << 20):  # a few bytes of overlap keep every n-gram
        part = raw[lo : lo + (1 << 20) + ORDERS - 1].astype(np.uint32)
        h = np.zeros(len(part), np.uint32)
        for n in range(1, ORDERS + 1):
            if len(part) < n:
                break
            h = h[: len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1 :] + np.uint32(n)
            on[(h * np.uint32(0x9E3779B1)) >> np.uint32(17)] = True
    return on


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # landmarks x FEATURES / 8 bytes: the slots of each landmark as bits
    weights: np.ndarray  # landmarks x languages

    def scores(self, texts: list[str], marks: np.ndarray | None = None) -> np.ndarray:
        """A row of scores per text; marks: the landmarks, unpacked."""
        return kernel(np.stack([presence(t) for t in texts]), unpacked(self.landmarks) if marks is None else marks) @ self.weights


def unpacked(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(bits, axis=1).astype(bool)


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Shared slots of each pair of rows of x and y, divided by the root of the product of their numbers."""
    x, y = x.astype(np.float32, copy=False), y.astype(np.float32, copy=False)
    return x @ y.T / np.sqrt(np.maximum(x.sum(axis=1), 1)[:, None] * np.maximum(y.sum(axis=1), 1))


def fit(rows: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model | None:
    """A model from rows(id, text, lang), or None if no row has a text and a language.

    The sample holds about per_language rows of each language, by a hash of id and text; the landmarks are its first
    rows by that hash, the languages taking turns, at least one of each.
    """
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL")
    place = F.pmod(F.xxhash64(F.col("id").cast("string"), "text", F.lit("fit")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    counts = stored(rows.groupBy("lang").agg(F.count("*").alias("n")), "language-counts")
    picked = rows.join(counts, "lang").withColumn("place", place).where(F.col("place") * F.col("n") < per_language)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                packed = [np.packbits(presence(t)).tobytes() for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), part.column(1), part.column(2)], ["bits", "lang", "place"])

    found = picked.select("text", "lang", "place").mapInArrow(bits, "bits binary, lang string, place double")
    found = stored(found, "language-sample")
    per = {r["lang"]: r["n"] for r in found.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not per:
        return None
    languages = sorted(per)
    turn = F.row_number().over(W.partitionBy("lang").orderBy("place", "bits"))  # the sample is bounded
    marks = found.withColumn("nth", turn).orderBy("nth", "lang").limit(max(landmarks, len(languages))).collect()
    packed = np.stack([np.frombuffer(r["bits"], np.uint8) for r in marks])
    w, v = np.linalg.eigh(kernel(unpacked(packed), unpacked(packed)).astype(np.float64))
    keep = w > 1e-6 * w.max()
    root = v[:, keep] / np.sqrt(w[keep])
    size, k = root.shape[1], len(languages)
    shared = rows.sparkSession.sparkContext.broadcast((packed, root))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y = unpacked(shared.value[0]).astype(np.float32)
        a, t = np.zeros((size, size)), np.zeros((size, k))
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                x = unpacked(np.stack([np.frombuffer(r, np.uint8) for r in part.column(0).to_pylist()]))
                phi = kernel(x, y).astype(np.float64) @ shared.value[1]
                label = [languages.index(r) for r in part.column(1).to_pylist()]
                weighed = phi / np.array([per[languages[c]] for c in label])[:, None]  # each language weighs alike
                a += phi.T @ weighed
                np.add.at(t.T, label, weighed)
        cells = np.hstack([a, t]).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells.size), pa.int64()), pa.array(cells)], ["cell", "part"])

    cells = np.zeros(size * (size + k))
    for r in found.select("bits", "lang").mapInArrow(sums, "cell long, part double").groupBy("cell").agg(F.sum("part").alias("part")).collect():
        cells[r["cell"]] = r["part"]  # landmarks x (landmarks + languages) numbers
    cells = cells.reshape(size, size + k)
    weights = root @ np.linalg.solve(cells[:, :size] + RIDGE * np.eye(size), cells[:, size:])
    return Model(languages, packed, weights.astype(np.float32))


def predict(rows: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", batch: int = 128) -> DataFrame:
    """id_col, lang_pred and score of every row; the text alone decides.

    A text that is null or has no letter is UNKNOWN with score 0, as is every text without a model.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        y = unpacked(m.landmarks).astype(np.float32) if m else None
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                texts = part.column(1).to_pylist()
                at = [k for k, t in enumerate(texts) if m and t and has_letter(t)]
                lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if at:
                    s = m.scores([texts[k] for k in at], y)
                    best = s.argmax(axis=1)
                    score[at] = np.clip(s.max(axis=1), 0, 1)
                    for k, i in zip(at, best):
                        lang[k] = m.languages[i]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [id_col, "lang_pred", "score"])

    found = rows.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    return found.mapInArrow(run, f"`{id_col}` long, lang_pred string, score double")


def held_out(id_: object) -> object:
    """Whether a row is held out of training: CRC-32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: id_col, held_out, lang_pred, score; fitted on the rows that aren't held out.

    A null id is not held out.  Repeated rows are alike; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = fit(rows.where(~held_out(F.col("id"))))
    out = predict(docs, model, id_col, text_col)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")
