"""Language of a text in two steps: its family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillworks.llm import samples, shared
from rillworks.llm.words import raw

#: Language families by ISO 639 code. A language that is not listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "is": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic", "sr": "slavic", "hr": "slavic", "sl": "slavic",
    "fi": "uralic", "et": "uralic", "hu": "uralic", "lt": "baltic", "lv": "baltic", "hi": "indic", "bn": "indic", "ur": "indic",
    "tr": "turkic", "az": "turkic", "kk": "turkic", "id": "malayic", "ms": "malayic",
}
SAMPLE = 1200
DIMENSIONS = 1 << 13
ORDERS = (1, 2, 3, 4)
UNKNOWN = "und"
_SCALE = 30.0
_CHUNK = 1 << 20
#: ASCII other than letters becomes a space, capitals become small letters, other bytes stay.
_FOLD = np.array([b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint32)


def features(text: bytes) -> Iterator[np.ndarray]:
    """Hashed byte n-grams of a whole text, a piece at a time."""
    data = np.frombuffer(text, np.uint8)
    longest = max(ORDERS)
    for at in range(0, len(data), _CHUNK):
        code = part = _FOLD[data[at:at + _CHUNK + longest - 1]]
        for n in range(1, longest + 1):
            if n > 1:
                code = code[:-1] * np.uint32(0x01000193) + part[n - 1:]
            yield ((code[:_CHUNK] + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(19)


def profile(text: bytes) -> np.ndarray:
    """Relative frequencies of the features, scaled."""
    counts = np.zeros(DIMENSIONS)
    for f in features(text):
        counts += np.bincount(f, minlength=DIMENSIONS)
    return (counts * (_SCALE / max(1.0, counts.sum()))).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 150, rate: float = 0.05) -> np.ndarray:
    """Weights and bias of a linear machine for y in {-1, 1}: squared hinge loss, both sides weighted alike, by Adam."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, m, v = (np.zeros(x.shape[1] + 1, np.float32) for _ in range(3))
    for t in range(1, rounds + 1):
        slack = np.maximum(0, 1 - y * (x @ w[:-1] + w[-1])) * y * weight * -2
        g = np.append(slack @ x + penalty * w[:-1], slack.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w


@dataclass
class Model:
    """`table` holds a column of weights for each family (if there are several), then for each pair within a family."""

    families: list[list[str]] = field(default_factory=list)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    table: np.ndarray = field(default_factory=lambda: np.zeros((DIMENSIONS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def margins(self, text: bytes) -> np.ndarray:
        total, n = np.zeros(self.table.shape[1]), 0
        for f in features(text):
            total += self.table[f].sum(axis=0, dtype=np.float64)
            n += len(f)
        return total * (_SCALE / max(1, n)) + self.bias

    def predict(self, text: bytes) -> tuple[str, float]:
        """The language and the share of belief in it: that of its family times that in the family."""
        if not self.families:
            return UNKNOWN, 0.0
        m = self.margins(text)
        several = len(self.families) if len(self.families) > 1 else 0
        belief, inside = 1.0, self.families[0]
        if several:
            p = np.exp(3 * (m[:several] - m[:several].max()))
            best = int(p.argmax())
            belief, inside = float(p[best] / p.sum()), self.families[best]
        if len(inside) == 1:
            return inside[0], belief
        for_it = dict.fromkeys(inside, 0.0)
        for (a, b), margin in zip(self.pairs, m[several:]):
            if a in for_it:
                p = 1 / (1 + np.exp(-3 * np.clip(margin, -20, 20)))
                for_it[a] += p
                for_it[b] += 1 - p
        best = max(sorted(for_it), key=for_it.get)
        return best, belief * float(for_it[best]) / (len(inside) - 1)


def fit(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", lang: str = "lang",
        sample: int = SAMPLE, families: dict[str, str] | None = None) -> Model:
    """Learns from at most `sample` texts, dealt evenly over the languages of the rows that `train` marks."""
    families = FAMILIES if families is None else families
    labelled = samples.learnable(docs.filter(F.col(text).isNotNull()), key, lang, train)
    known = [r[0] for r in labelled.select(lang).distinct().orderBy(lang).limit(sample).collect()]
    if not known:
        return Model()
    chosen = samples.sampled(labelled, docs.select(key, text), key, lang, max(1, sample // len(known)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.slices(batches):
            found = [profile(t or b"").tobytes() for t in raw(b.column("t"))]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("l"), pa.array(found, pa.binary())], ["k", "l", "x"])

    rows = chosen.select(F.col(key).cast("string").alias("k"), F.col(lang).alias("l"), F.col(text).alias("t")).mapInArrow(run, "k string, l string, x binary").collect()
    rows.sort(key=lambda r: (r["k"], r["x"]))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows])
    y = np.array([r["l"] for r in rows])
    groups: dict[str, list[str]] = {}
    for name in known:
        groups.setdefault(families.get(name, name), []).append(name)
    columns, pairs = [], []
    if len(groups) > 1:
        columns = [svm(x, np.where(np.isin(y, names), 1, -1).astype(np.float32)) for names in groups.values()]
    for names in groups.values():
        for a, b in combinations(names, 2):
            part = (y == a) | (y == b)
            pairs.append((a, b))
            columns.append(svm(x[part], np.where(y[part] == a, 1, -1).astype(np.float32)))
    table = np.stack(columns, axis=1) if columns else np.zeros((DIMENSIONS + 1, 0), np.float32)
    return Model(list(groups.values()), pairs, np.ascontiguousarray(table[:-1]), table[-1])


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of `docs` with lang_pred and lang_score (0 to 1), from the text alone; columns of these names are replaced.

    Texts that are NULL or have no letter, and all texts if the model saw no language, get `und` and 0.
    """
    docs = docs.drop("lang_pred", "lang_score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    shared_model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared_model.value
        for b in shared.slices(batches):
            column = b.column(b.schema.get_field_index(text))
            said = [m.predict(r) if t and any(c.isalpha() for c in t) else (UNKNOWN, 0.0) for t, r in zip(column.to_pylist(), raw(column))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())], [*b.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(run, schema)
