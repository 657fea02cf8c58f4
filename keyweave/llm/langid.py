"""Language identification with string kernels.

The kernel of two texts blends the character n-grams of length 1 to 3: for each length, the
n-grams present in both over the geometric mean of those present in each. Landmarks (Nyström)
stand for the training texts; one-versus-rest ridge regression in that space has a closed form.
As the kernel is linear in the presence vectors, a batch of texts is scored by one product of its
presence matrix with the landmarks' weighted sum, which equals the product through the landmarks.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyweave.llm._common import checkpointed, small_batches

#: Bits of the hashed presence vector for n-grams of length 1, 2, 3.
BITS = (10, 13, 14)
OFFSETS = np.cumsum([0, *(1 << b for b in BITS)])
#: Bounds of the fit: rows per language, rows in all, landmarks in all, languages. Scoring has none. The model has 100 KB for each language.
ROWS_EACH, MOST_ROWS, LANDMARKS, LANGUAGES = 200, 2000, 256, 256
RIDGE = 1e-3
#: Texts in one matrix product.
BATCH = 64
#: From this score on a prediction contradicts a declared language.
CONFIDENT = 0.8
UNKNOWN = "und"

#: Odd multipliers of the n-gram hash.
MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _places(text: str | None) -> np.ndarray | None:
    """Places of the text's n-grams in the presence vector; None without a letter.

    Letters are lower-cased; each run of anything else counts as one space, and so do both ends.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return None
    first_other = ~letter & np.r_[True, letter[:-1]]
    points = np.where(letter, points, np.uint32(32))[letter | first_other]
    points = np.r_[np.uint32(32), points, np.uint32(32)].astype(np.uint32)
    found, code = [], np.zeros(len(points), np.uint32)
    for n, bits in enumerate(BITS):
        code = (code[: len(points) - n] * np.uint32(31) + points[n:]) * MIX[n]
        code ^= code >> np.uint32(15)
        found.append(((code * MIX[0]) >> np.uint32(32 - bits)).astype(np.int64) + OFFSETS[n])
        code = code[: len(points) - n - 1]
    return np.concatenate(found)


def _presence(places: list[np.ndarray]) -> np.ndarray:
    """Rows of presence, each length of n-grams scaled to norm 1 / sqrt(3), so that products are kernels."""
    x = np.zeros((len(places), OFFSETS[-1]), np.float32)
    for i, p in enumerate(places):
        x[i, p] = 1
    return _scaled(x)


def _scaled(x: np.ndarray) -> np.ndarray:
    for a, b in zip(OFFSETS, OFFSETS[1:]):
        x[:, a:b] /= np.sqrt(np.maximum(x[:, a:b].sum(axis=1, keepdims=True), 1) * len(BITS))
    return x


class Model(NamedTuple):
    langs: tuple[str, ...]
    weights: np.ndarray  # presence to language; len(langs) * 100 KB

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for at in range(0, len(texts), BATCH):
            places = [_places(t) for t in texts[at : at + BATCH]]
            known = [i for i, p in enumerate(places) if p is not None]
            if not known or not self.langs:
                continue
            outputs = _presence([places[i] for i in known]) @ self.weights
            best = outputs.argmax(axis=1)
            for i, b, output in zip(known, best, outputs):
                names[at + i] = self.langs[b]
                scores[at + i] = min(1.0, max(0.0, (1.0 + float(output[b])) / 2))
        return names, scores


def solve(presence: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """One-versus-rest kernel ridge regression on Nyström landmarks, which are dealt evenly to the languages."""
    names = tuple(sorted(set(langs)))
    if not names:
        return Model((), np.zeros((OFFSETS[-1], 0), np.float32))
    x = _scaled(presence.astype(np.float32))
    seen: Counter[str] = Counter()
    order = []
    for i, lang in enumerate(langs):
        order.append((seen[lang], lang, i))
        seen[lang] += 1
    chosen = [i for _, _, i in sorted(order)[: max(landmarks, len(names))]]
    marks = x[chosen]
    k_nm, k_mm = (x @ marks.T).astype(np.float64), (marks @ marks.T).astype(np.float64)
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    system = k_nm.T @ k_nm + ridge * len(x) * k_mm + 1e-8 * np.trace(k_mm) * np.eye(len(k_mm))
    alpha = np.linalg.solve(system, k_nm.T @ y)
    return Model(names, (marks.T @ alpha).astype(np.float32))


def remainder(key: str) -> Column:
    """crc32 of the key as text, modulo 4; 2 marks the held-out fold. Null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4))


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learns from texts with a language outside the held-out fold: of each language those with the least hashes.

    At most ROWS_EACH texts of a language and MOST_ROWS in all reach the driver, as bits of 3.2 KB; only the LANGUAGES
    languages with most texts (ties by name) are learned. The number of rows in df doesn't matter.
    """
    rows = df.where((remainder(key) != 2) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("hash"), F.col(text).alias("text"))
    keys = checkpointed(rows.select("lang", "hash").distinct())
    counts = checkpointed(keys.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES))
    each = min(ROWS_EACH, MOST_ROWS // max(1, counts.count()))
    # About four times as many as wanted have a hash low enough; only these are ranked, however many a language has.
    low = F.pmod("hash", F.lit(1 << 30)) < F.lit(4.0 * each * (1 << 30)) / F.col("n")
    near = keys.join(F.broadcast(counts), "lang").where(low)  # LANGUAGES rows at most
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("hash", F.lit(1 << 30)), "hash"))
    wanted = near.withColumn("rank", rank).where(F.col("rank") <= each).select("lang", "hash")
    wanted = checkpointed(wanted)

    def pack(texts: pd.Series) -> pd.Series:
        out = []
        for places in map(_places, texts):
            bits = np.zeros(OFFSETS[-1], bool)
            if places is not None:
                bits[places] = True
            out.append(np.packbits(bits).tobytes())
        return pd.Series(out)

    chosen = rows.join(F.broadcast(wanted), ["lang", "hash"])  # MOST_ROWS at most
    found = chosen.groupBy("lang", "hash").agg(F.first("text").alias("text")).select("lang", "hash", F.pandas_udf(pack, "binary")("text").alias("bits"))
    with small_batches(df.sparkSession):
        sample = sorted(found.collect(), key=lambda r: (r.lang, r.hash))
    bits = np.unpackbits(np.frombuffer(b"".join(bytes(r.bits) for r in sample), np.uint8).reshape(len(sample), -1), axis=1, count=int(OFFSETS[-1])) if sample else np.zeros((0, OFFSETS[-1]), np.uint8)
    return solve(bits, [r.lang for r in sample])


def _predict(df: DataFrame, text: str, model: Model) -> Column:
    shared = df.sparkSession.sparkContext.broadcast(model)

    def predict(texts: pd.Series) -> pd.DataFrame:
        names, scores = shared.value.score([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"lang_pred": names, "score": scores})

    # Not marked as deterministic, or a filter on the prediction would have it computed once more for itself.
    return F.pandas_udf(predict, "lang_pred string, score double").asNondeterministic()(F.col(text))


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of df: doc_id, held_out, lang_pred, score.

    The model is fitted on df itself, outside the fold where crc32(key as text) mod 4 is 2. Only the
    text enters a prediction, all of it. score is the winner's regression output, -1 to 1, mapped to 0 to 1.

    Null texts and those without a letter are "und" with score 0, and so is everything if no row has a
    language. A null key is neither held out nor learned from. Repeated rows get equal predictions,
    ties go to the language first in code point order; an empty table gives an empty result; other
    columns are not looked at.
    """
    model = fit(df, key, text, lang)
    rows = df.select(F.col(key).alias("doc_id"), F.coalesce(remainder(key) == 2, F.lit(False)).alias("held_out"), _predict(df, text, model).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of df, with all columns, but for those without an identified language and those whose
    declared language is contradicted with a score of CONFIDENT or more."""
    model = fit(df, key, text, lang)
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(lang).cast("string").alias("lang"), _predict(df, text, model).alias("p"))
    contradicted = F.coalesce((F.col("lang") != F.col("p.lang_pred")) & (F.col("p.score") >= CONFIDENT), F.lit(False))
    return rows.where((F.col("p.lang_pred") != UNKNOWN) & ~contradicted).select("row.*")
