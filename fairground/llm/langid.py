"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from fairground.llm.common import named, small_batches

#: Hashed n-grams of one to three letters.
BUCKETS = 1 << 14
ORDERS = 3
#: Training rows in all, shared evenly among the languages.
SAMPLE_ROWS = 4000
#: Follow-the-regularised-leader with elastic net.
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 1e-3, 1e-4, 2
#: Characters of a text that are turned into n-grams at once.
CHUNK = 1 << 20

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTER[0]


def counts(text: str | None) -> np.ndarray | None:
    """How often each bucket's n-grams occur in the whole text; None if it has no letter."""
    if not text:
        return None
    letter, total, seen = _letters(), np.zeros(BUCKETS, dtype=np.int64), False
    carry = np.array([32], dtype=np.uint64)
    for lo in range(0, len(text), CHUNK):
        code = np.frombuffer(text[lo : lo + CHUNK].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        is_letter = letter[code]
        seen = seen or bool(is_letter.any())
        code[~is_letter] = 32
        a = np.concatenate((carry, code))
        keep = np.ones(len(a), dtype=bool)
        keep[1:] = (a[1:] != 32) | (a[:-1] != 32)
        keep[: len(carry)] = True
        a = a[keep]
        h = np.zeros(len(a), dtype=np.uint64)
        for n in range(1, ORDERS + 1):
            with np.errstate(over="ignore"):
                h = (h[: len(a) - n + 1] if n > 1 else h) * np.uint64(0x100000001B3) + a[n - 1 :] + np.uint64(n)
                own = h[max(0, len(carry) - n + 1) :]
                total += np.bincount(((own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int64), minlength=BUCKETS)
        carry = a[-(ORDERS - 1) :]
    return total if seen else None


def _features(c: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(c)
    x = (1.0 + np.log(c[at])) * idf[at]
    norm = np.sqrt((x * x).sum())
    return at.astype(np.int32), (x / norm if norm > 0 else x).astype(np.float32)


def _document_frequencies(batches):
    df, rows = np.zeros(BUCKETS, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            c = counts(text)
            if c is not None:
                df += c > 0
                rows += 1
    at = np.flatnonzero(df)
    yield pa.record_batch({"bucket": pa.array(np.append(at, -1), pa.int32()), "df": pa.array(np.append(df[at], rows))})


def _sample_features(batches, idf: np.ndarray):
    for batch in batches:
        rows = [(i, lang, _features(c, idf)) for i, lang, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), map(counts, batch.column(2).to_pylist()), strict=True) if c is not None]
        yield pa.record_batch({
            "place": pa.array([r[0] for r in rows], pa.int64()), "lang": pa.array([r[1] for r in rows], pa.string()),
            "at": pa.array([r[2][0] for r in rows], pa.list_(pa.int32())), "x": pa.array([r[2][1] for r in rows], pa.list_(pa.float32())),
        })


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int) -> np.ndarray:
    """Weights (classes x BUCKETS + 1, the last is the bias) by FTRL-proximal with L1 and L2."""
    z, n = np.zeros((classes, BUCKETS + 1)), np.zeros((classes, BUCKETS + 1))

    def weights(at) -> np.ndarray:
        zi, ni = z[:, at], n[:, at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for y, at, x in rows:
            at, x = np.append(at, BUCKETS), np.append(x, 0.1)
            w = weights(at)
            p = softmax(w @ x)
            p[y] -= 1.0
            g = p[:, None] * x[None, :]
            step = (np.sqrt(n[:, at] + g * g) - np.sqrt(n[:, at])) / ALPHA
            z[:, at] += g - step * w
            n[:, at] += g * g
    return weights(slice(None))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits that minimises the loss on rows not trained on; golden section."""
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
    lo, hi, ratio = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _fit(pdf, languages: list[str]):
    import pandas as pd

    pdf = pdf.sort_values(["place", "lang"])
    index = {c: i for i, c in enumerate(languages)}
    rows = [(index[c], np.asarray(at), np.asarray(x, dtype=np.float64)) for c, at, x in zip(pdf["lang"], pdf["at"], pdf["x"], strict=True)]
    fit, held = [r for i, r in enumerate(rows) if i % 5], [r for i, r in enumerate(rows) if i % 5 == 0]
    w = train(fit, len(languages))
    t = 1.0
    if held and len(languages) > 1:
        t = temperature(np.array([w[:, at] @ x + 0.1 * w[:, BUCKETS] for _, at, x in held]), np.array([r[0] for r in held]))
    k, b = np.nonzero(w)
    out = pd.DataFrame({"k": k, "bucket": b, "w": w[k, b] / t})
    return pd.concat([out, pd.DataFrame({"k": [-1], "bucket": [-1], "w": [t]})])


class Model:
    """Languages, inverse document frequencies, weights divided by the temperature: of bounded size."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float) -> None:
        self.languages, self.idf, self.weights, self.temperature = languages, idf, weights, temperature

    def probabilities(self, text: str | None) -> np.ndarray | None:
        c = counts(text)
        if c is None or not self.languages:
            return None
        at, x = _features(c, self.idf)
        return softmax(self.weights[:, at] @ x + 0.1 * self.weights[:, BUCKETS])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from all rows whose language isn't null: document frequencies from every whole text,
    weights and temperature from a sample of at most sample_rows rows (evenly by language, by a hash
    of the id). The sample and the model are of bounded size; texts never reach the driver.

    Null texts and texts without letters teach nothing. An empty table gives a model that knows no
    language. Languages are ordered by name."""
    spark = labelled.sparkSession
    small_batches(spark)
    rows = labelled.select(labelled[id_col].alias("id"), labelled[text_col].cast("string").alias("text"), labelled[lang_col].cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(found)
    if not languages:
        return Model([], np.zeros(BUCKETS), np.zeros((0, BUCKETS + 1)), 1.0)
    df = rows.select("text").mapInArrow(_document_frequencies, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    have = df[df.bucket >= 0]
    n, idf = int(df[df.bucket < 0].df.sum()), np.zeros(BUCKETS)
    idf[have.bucket] = np.log((1 + n) / (1 + have.df)) + 1.0
    each = max(1, sample_rows // len(languages))
    share = F.create_map(*[F.lit(v) for c in languages for v in (c, min(1.0, 2.0 * each / found[c] + 50 / found[c]))])
    place = F.xxhash64("id", F.lit("sample"))
    drawn = rows.withColumn("place", place).where(F.pmod("place", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    ranked = drawn.select("place", "lang", "text", F.row_number().over(W.partitionBy("lang").orderBy("place", "text")).alias("rank")).where(F.col("rank") <= each)
    sample = ranked.select("place", "lang", "text").mapInArrow(partial(_sample_features, idf=idf), "place long, lang string, at array<int>, x array<float>")
    learnt = sample.groupBy(F.lit("all")).applyInPandas(lambda pdf: _fit(pdf, languages), "k int, bucket int, w double").toPandas()
    w = np.zeros((len(languages), BUCKETS + 1))
    own = learnt[learnt.k >= 0]
    w[own.k, own.bucket] = own.w
    return Model(languages, idf, w, float(learnt[learnt.k < 0].w.iloc[0]) if len(learnt) else 1.0)


def _predict(batches, model: Model):
    for batch in batches:
        lang, score = [], []
        for text in batch.column(batch.num_columns - 1).to_pylist():
            p = model.probabilities(text)
            lang.append("und" if p is None else model.languages[int(p.argmax())])
            score.append(0.0 if p is None else float(p.max()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns named in keep, lang_pred and score (the calibrated probability of lang_pred).

    The whole text counts, nothing else. `und` with score 0 if the text is null or has no letter, or
    the model knows no language. Rows come as often as they are in the table; none are shuffled."""
    small_batches(docs.sparkSession)
    keep = keep or ["doc_id"]
    rows = docs.select(*[named(docs, c) for c in keep], named(docs, text_col).cast("string").alias("_text_"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(partial(_predict, model=model), schema)


def held_out(id_col) -> object:
    """Whether a row is kept from learning: crc32 of its id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0, F.lit(False))
