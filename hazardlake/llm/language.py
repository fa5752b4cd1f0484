"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lowered, every stretch of characters other than letters becomes one
blank, and n-grams of one to three characters are hashed into buckets. Training
counts buckets per language in every task (whole texts, all labelled rows) and
adds them up in Spark; the driver receives one number per language and bucket.
The log-probability matrix has at most ``MAX_CELLS`` numbers (64 MB): with more
languages there are fewer buckets. It is broadcast, and a batch of documents is
scored by looking up its n-grams and adding them per document.

A document's sum runs over its own n-grams in order, so it does not depend on
batches or partitions.

Cases: null text, or one without letters, is ``und`` with score 0; without any
labelled document all are; a null label is not learned from; ties go to the
language that sorts first; repeated rows each get a row; an empty table gives
an empty result; other columns pass through.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardlake.llm.common import arrow_bytes, pieces

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
MAX_CELLS = 8 << 20
PIECE = 1 << 20  # bytes of text looked at together


class Model(NamedTuple):
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # languages x (buckets + 1); the last bucket stands for no n-gram


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(raw: np.ndarray, offsets: np.ndarray, buckets: int):
    """Bucket of every n-gram, one array per order; starts of the documents; letters per document.

    Texts begin with a blank, so no document is empty.
    """
    first = (raw & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(first)])[offsets]
    chars = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    letter = letters()[chars]
    n_letters = np.add.reduceat(letter.astype(np.int64), at[:-1])
    chars = np.where(letter, chars, np.uint32(32))
    keep = np.ones(len(chars), bool)
    keep[1:] = (chars[1:] != 32) | (chars[:-1] != 32)
    keep[at[:-1]] = True
    starts = np.concatenate([[0], np.cumsum(keep)])[at]
    chars = chars[keep]
    found = []
    for n in ORDERS:
        h = np.full(len(chars), n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for j in range(n):
            part = chars[j:] if j else chars
            h[: len(part)] = (h[: len(part)] ^ part) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
        bucket = (h & np.uint32(buckets - 1)).astype(np.int64)
        for j in range(1, n):  # the last places of a document begin no n-gram
            bucket[np.maximum(starts[1:] - j, starts[:-1])] = buckets
        found.append(bucket)
    return found, starts[:-1], n_letters


def prepared(text: Column) -> Column:
    return F.concat(F.lit(" "), F.coalesce(F.lower(text), F.lit("")))


def train(docs: DataFrame, text: Column, lang: Column, smoothing: float = 0.1) -> Model:
    """Learn from all rows whose language is not null."""
    rows = docs.select(prepared(text).alias("text"), lang.cast("string").alias("lang")).filter(F.col("lang").isNotNull())
    # one row per language
    known = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(known)
    buckets = BUCKETS
    while languages and buckets * len(languages) > MAX_CELLS:
        buckets //= 2
    code = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), buckets + 1), np.int64)
        for b in batches:
            raw, off = arrow_bytes(b.column("text"))
            who = np.array([code[x] for x in b.column("lang").to_pylist()], dtype=np.int64)
            for i, j in pieces(off, PIECE):
                found, starts, _ = grams(raw[off[i] : off[j]], off[i : j + 1] - off[i], buckets)
                n = len(found[0])
                row = np.repeat(who[i:j], np.diff(np.append(starts, n))) * (buckets + 1)
                for bucket in found:
                    total += np.bincount(row + bucket, minlength=total.size).reshape(total.shape)
        lang_at, bucket_at = np.nonzero(total[:, :buckets])
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang_at.astype(np.int32)), pa.array(bucket_at.astype(np.int32)), pa.array(total[lang_at, bucket_at])], names=["l", "b", "n"]
        )

    counts = np.zeros((len(languages), buckets))
    if languages:
        # at most MAX_CELLS rows come back
        table = rows.mapInArrow(count, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()
        counts[table["l"].to_numpy(), table["b"].to_numpy()] = table["n"].to_numpy()
    log_prob = np.log(counts + smoothing) - np.log(counts.sum(axis=1, keepdims=True) + smoothing * buckets)
    n_docs = np.array([known[x] for x in languages], dtype=float)
    return Model(languages, np.log(n_docs / max(n_docs.sum(), 1.0)), np.hstack([log_prob, np.zeros((len(languages), 1))]))


def predict(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its posterior probability."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.columns
    rows = docs.withColumn("_lid_text", prepared(F.col(text_col)))
    schema = T.StructType([*docs.schema.fields, T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array([*m.languages, "und"], dtype=object)
        for b in batches:
            raw, off = arrow_bytes(b.column("_lid_text"))
            pred, best = np.full(b.num_rows, len(m.languages)), np.zeros(b.num_rows)
            for i, j in pieces(off, PIECE) if m.languages else []:
                found, starts, n_letters = grams(raw[off[i] : off[j]], off[i : j + 1] - off[i], m.log_prob.shape[1] - 1)
                fit = np.repeat(m.log_prior[:, None], j - i, axis=1)
                for k in range(len(m.languages)):
                    for bucket in found:
                        fit[k] += np.add.reduceat(m.log_prob[k][bucket], starts)
                top = fit.argmax(axis=0)
                share = 1.0 / np.exp(fit - fit.max(axis=0)).sum(axis=0)
                pred[i:j], best[i:j] = np.where(n_letters > 0, top, len(m.languages)), np.where(n_letters > 0, share, 0.0)
            cols = [b.column(c) for c in rest]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(names[pred], pa.string()), pa.array(best)], names=[*rest, pred_col, score_col])

    return rows.mapInArrow(score, schema)


def held_out(id_col: Column) -> Column:
    """A fifth of the documents, by identifier."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score. Held-out rows are not learned from."""
    model = train(docs.filter(~held_out(F.col(id_col))), F.col(text_col), F.col(lang_col))
    rows = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("_text"))
    return predict(rows, model, "_text").select(id_col, "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` in which a language was found, with all their columns.

    Without any label to learn from, all rows whose text has a letter stay.
    """
    model = train(docs.filter(~held_out(F.col(id_col))), F.col(text_col), F.col(lang_col))
    if not model.languages:
        return docs.filter(F.col(text_col).rlike(r"\p{L}"))
    return predict(docs, model, text_col, "_lid_pred", "_lid_score").filter("_lid_pred <> 'und'").select(*docs.columns)
