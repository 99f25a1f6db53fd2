"""Language ID with a byte convolutional network trained in numpy.

The network looks at windows of WINDOW bytes of the lower-cased text: filters of several widths over the raw bytes,
the maximum of each filter over the window, and a softmax layer. A text is cut whole into windows, in batches of
fixed shape; its probabilities are the means over its windows, weighted by the bytes each holds. A filter over one-hot
bytes is a sum of table look-ups, so two bytes at a time are looked up in tables built from the trained weights.

The fit sees at most PER_LANG texts of each learned language and WINDOWS_EACH windows of a text; a hash of doc_id
chooses them. It learns only from rows with a language and a doc_id whose crc32 modulo 4 is not 2.

Cases: a null text, or one without a letter, is `und` with score 0; with nothing to learn from all are `und`; a null
doc_id is not held out and not learned from; repeated rows are each returned; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from . import common

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
PER_LANG = 500
WINDOWS_EACH = 4
EPOCHS = 8
BATCH = 64
RATE = 0.02
CHUNK = 256
UNKNOWN = "und"
MIN_SCORE = 0.4


def remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def training_windows(docs: DataFrame) -> list[tuple[str, bytes]]:
    """(lang, bytes of one window) of the bounded sample."""
    known = docs.filter(F.col("lang").isNotNull() & (remainder() != 2) & (F.octet_length("text") > 0))
    counts = docs.filter(F.col("lang").isNotNull() & (remainder() != 2)).groupBy("lang").count()
    counts = F.broadcast(counts.withColumn("share", PER_LANG * 2.0 / F.col("count")).drop("count"))  # a row per language
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.select("doc_id", "lang", "text", draw.alias("draw")).join(counts, "lang").filter(F.col("draw") < F.col("share"))
    size = F.octet_length("text")
    at = [F.floor((size - WINDOW) * k / max(1, WINDOWS_EACH - 1)).cast("int") for k in range(WINDOWS_EACH)]
    starts = F.when(size <= WINDOW, F.array(F.lit(0))).otherwise(F.array(*at))
    windows = F.transform(starts, lambda s: F.substring(F.col("text").cast("binary"), s + 1, F.lit(WINDOW)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "windows"))
    picked = drawn.select("lang", "draw", "doc_id", windows.alias("windows")).withColumn("rank", rank).filter(F.col("rank") <= PER_LANG)
    return sorted((r["lang"], bytes(w)) for r in picked.select("lang", "windows").collect() for w in r["windows"])


def to_windows(text: bytes) -> np.ndarray:
    """The whole text as rows of WINDOW bytes, and zeros after the end and after each row for the widest filter."""
    n = max(1, -(-len(text) // WINDOW))
    out = np.zeros((n, WINDOW + max(WIDTHS) - 1), np.uint8)
    flat = np.zeros(n * WINDOW, np.uint8)
    flat[: len(text)] = np.frombuffer(text, np.uint8)
    out[:, :WINDOW] = flat.reshape(n, WINDOW)
    return out


def tables(filters: list[np.ndarray]) -> dict:
    """Look-up tables of the convolutions: bytes 0-1 for all widths, and what is left of each width."""
    pair = lambda w, i: (w[i][:, None, :] + w[i + 1][None, :, :]).reshape(65536, -1)
    first = np.concatenate([pair(w, 0) for w in filters], 1).astype(np.float32)
    rest = []
    for w in filters:
        own = [(i, pair(w, i).astype(np.float32), True) for i in range(2, len(w) - 1, 2)]
        rest.append(own + ([(len(w) - 1, w[-1].astype(np.float32), False)] if len(w) % 2 else []))
    return {"first": first, "rest": rest}


def convolve(rows: np.ndarray, t: dict) -> np.ndarray:
    """(rows, WINDOW, filters): what every filter gives at every place."""
    wide = rows.astype(np.int32)
    pairs = (wide[:, :-1] << 8) | wide[:, 1:]
    out = t["first"][pairs[:, :WINDOW]]
    for k, own in enumerate(t["rest"]):
        part = out[:, :, k * FILTERS : (k + 1) * FILTERS]
        for i, lookup, paired in own:
            part += lookup[(pairs if paired else wide)[:, i : i + WINDOW]]
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(samples: list[tuple[str, bytes]], seed: int = 7) -> dict | None:
    """Filters, bias and the softmax layer, fitted with Adam; only the places that gave a maximum get a gradient."""
    if not samples:
        return None
    langs = sorted({s[0] for s in samples})
    rows = np.concatenate([to_windows(s[1].lower()[:WINDOW]) for s in samples])
    goal = np.array([langs.index(s[0]) for s in samples])
    rng = np.random.default_rng(seed)
    n = FILTERS * len(WIDTHS)
    p = [rng.normal(0, 0.3, (w, 256, FILTERS)) for w in WIDTHS] + [np.zeros(n), rng.normal(0, 0.3, (n, len(langs))), np.zeros(len(langs))]
    m, v, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            pick = order[at : at + BATCH]
            x, y = rows[pick], goal[pick]
            z = convolve(x, tables(p[: len(WIDTHS)]))
            where = z.argmax(1)
            top = np.take_along_axis(z, where[:, None, :], 1)[:, 0, :] + p[-3]
            h = np.maximum(top, 0)
            d = softmax(h @ p[-2] + p[-1])
            d[np.arange(len(y)), y] -= 1
            d /= len(y)
            back = (d @ p[-2].T) * (top > 0)
            g = [np.zeros_like(w) for w in p[: len(WIDTHS)]] + [back.sum(0), h.T @ d, d.sum(0)]
            for k, width in enumerate(WIDTHS):
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                for i in range(width):
                    seen = np.take_along_axis(x, where[:, own] + i, 1)
                    np.add.at(g[k][i], (seen, np.arange(FILTERS)[None, :]), back[:, own])
            step += 1
            for q, grad, a, b in zip(p, g, m, v, strict=True):
                a += 0.1 * (grad - a)
                b += 0.001 * (grad * grad - b)
                q -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return {"langs": langs, "params": [x.astype(np.float32) for x in p]}


def probabilities(texts: list[bytes], model: dict, t: dict) -> np.ndarray:
    """(texts, langs): the weighted mean over each text's windows; windows of all texts go through in batches of CHUNK."""
    counts = [max(1, -(-len(x) // WINDOW)) for x in texts]
    owner = np.repeat(np.arange(len(texts)), counts)
    weight = np.concatenate([np.r_[np.full(c - 1, WINDOW), max(1, len(x) - (c - 1) * WINDOW)] for c, x in zip(counts, texts, strict=True)])
    rows = np.concatenate([to_windows(x) for x in texts])
    total = np.zeros((len(texts), len(model["langs"])))
    bias, layer, offset = model["params"][-3:]
    for at in range(0, len(rows), CHUNK):
        h = np.maximum(convolve(rows[at : at + CHUNK], t).max(1) + bias, 0)
        np.add.at(total, owner[at : at + CHUNK], softmax(h @ layer + offset) * weight[at : at + CHUNK, None])
    return total / total.sum(1, keepdims=True)


def predictor(model: dict | None):
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @pandas_udf(kind)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = tables(model["params"][: len(WIDTHS)]) if model else None
        for batch in batches:
            lang, score = [UNKNOWN] * len(batch), [0.0] * len(batch)
            ok = [i for i, x in enumerate(batch) if model and x is not None and any(map(str.isalpha, x))]
            some, held = [], 0
            for i in ok:
                some.append((i, batch.iloc[i].encode().lower()))
                held += len(some[-1][1])
                if held > 1 << 22 or i == ok[-1]:
                    p = probabilities([x for _, x in some], model, t)
                    for (j, _), own in zip(some, p, strict=True):
                        lang[j], score[j] = model["langs"][int(own.argmax())], float(own.max())
                    some, held = [], 0
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return predict


def identify(docs: DataFrame) -> DataFrame:
    """docs with the column `_lang` (lang_pred, score), learned from its own labelled rows."""
    return docs.withColumn("_lang", predictor(train(training_windows(docs)))(F.col("text")))


def keep_known(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """docs without the rows whose language is unknown or too uncertain."""
    predict = predictor(train(training_windows(docs)))
    found = docs.select(common.whole(docs).alias("row"), predict(F.col("text")).alias("lang"))
    return found.filter((F.col("lang.lang_pred") != UNKNOWN) & (F.col("lang.score") >= min_score)).select(*common.columns_of(docs, "row"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), F.col("_lang.lang_pred").alias("lang_pred"), F.col("_lang.score").alias("score"))
