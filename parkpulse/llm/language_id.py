"""Language ID as inference of a mixture.

Training: counts of hashed byte trigrams per language, over all labelled documents. Texts are seen
in lower case with everything but letters and bytes above ASCII as a space.

Prediction: expectation-maximisation estimates the shares of the languages in one document, its
trigrams being drawn from the mixture. Starting from all languages, the one with the smallest share
is dropped for as long as the penalised likelihood (half a log of the sample size for each free
share) does not fall. The largest share names the language and is the score; ties go to the name
that comes first.

Null text and text without a letter are `und` with score 0, and so is everything if no labelled
document has a trigram. Rows are independent: ties, repeated rows and extra columns change nothing.
The model has languages x 65,536 numbers, whatever the size of the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parkpulse.llm.shared import read_table
from parkpulse.llm.wordhash import slices, text_buffers

BUCKETS = 1 << 16
UNKNOWN = "und"
SMOOTHING = 0.5
#: Overlapping trigrams count as this share of independent observations.
INDEPENDENT = 1 / 3
ROUNDS = 20

_LETTER = regex.compile(r"\p{L}")
_SEEN = np.full(256, 0x20, np.uint32)
for _c in (*range(0x61, 0x7B), *range(0x80, 0x100)):
    _SEEN[_c] = _c
_SEEN[0x41:0x5B] = np.arange(0x61, 0x7B)


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.crc32(doc_id.cast("string")) % folds == fold


def trigrams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets by document) of the trigrams of each document that hold a non-space."""
    data = _SEEN[raw[at[0] : at[-1]]]
    n = max(len(data) - 2, 0)
    code = data[:n] << np.uint32(16) | data[1 : n + 1] << np.uint32(8) | data[2 : n + 2]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16)
    edges = at - at[0]
    use = code != 0x202020
    for back in (1, 2):  # not across two documents
        cut = edges[1:-1] - back
        use[cut[(cut >= 0) & (cut < n)]] = False
    kept = np.flatnonzero(use)
    return bucket[kept], np.searchsorted(kept, edges)


def language_counts(docs: DataFrame) -> DataFrame:
    """lang, bucket, n over documents (lang, text) with a language."""

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            raw, at = text_buffers(batch.column(1))
            langs = batch.column(0).to_pylist()
            for first, last in slices(at):
                bucket, of = trigrams(raw, at[first : last + 1])
                for i, lang in enumerate(langs[first:last]):
                    total = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    total += np.bincount(bucket[of[i] : of[i + 1]], minlength=BUCKETS)
        for lang, total in counts.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])],
                ["lang", "bucket", "n"],
            )

    rows = docs.where("lang IS NOT NULL").select("lang", "text").mapInArrow(run, "lang string, bucket int, n bigint")
    return rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and the probability of each trigram bucket (rows) in each language (columns)."""
    rows = language_counts(docs).toArrow()
    langs = sorted(set(rows["lang"].to_pylist()))
    counts = np.zeros((BUCKETS, len(langs)))
    column = np.array([langs.index(x) for x in rows["lang"].to_pylist()], np.int64)
    counts[rows["bucket"].to_numpy(), column] = rows["n"].to_numpy()
    return langs, (counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * BUCKETS)


def _em(p: np.ndarray, weight: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares of the languages, and the log likelihood under them."""
    n = weight.sum()
    if p.shape[1] > 1:
        for _ in range(ROUNDS):
            new = share * ((weight / (p @ share)) @ p) / n
            change = np.abs(new - share).max()
            share = new
            if change < 1e-3:
                break
    return share, float(weight @ np.log(p @ share))


def mixture(bucket: np.ndarray, probabilities: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(languages, shares) of one document, the languages chosen by penalised likelihood."""
    seen = np.sort(bucket, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1]]))
    weight = np.diff(np.append(at, len(seen))) * INDEPENDENT
    p = probabilities[seen[at]]
    chosen = np.arange(p.shape[1])
    penalty = 0.5 * np.log(1 + len(bucket) * INDEPENDENT)
    share, fit_now = _em(p, weight, np.full(len(chosen), 1 / len(chosen)))
    while len(chosen) > 1:
        fewer = np.delete(np.arange(len(chosen)), len(chosen) - 1 - int(np.argmin(share[::-1])))
        rest = share[fewer] + 1e-9
        share_next, fit_next = _em(p[:, fewer], weight, rest / rest.sum())
        if fit_next < fit_now - penalty:
            break
        p, chosen, share, fit_now = p[:, fewer], chosen[fewer], share_next, fit_next
    return chosen, share


def _batch_mixtures(column: pa.Array, langs: list[str], probabilities: np.ndarray):
    """(language, score, number of languages) of each text."""
    raw, at = text_buffers(column)
    out = []
    for first, last in slices(at):
        bucket, of = trigrams(raw, at[first : last + 1])
        for i in range(first, last):
            mine = bucket[of[i - first] : of[i - first + 1]]
            if not langs or not _LETTER.search(raw[at[i] : at[i + 1]].tobytes().decode()):
                out.append((UNKNOWN, 0.0, 0))
                continue
            if len(mine) == 0:  # one or two letters
                short = np.concatenate([[0x20], _SEEN[raw[at[i] : at[i + 1]]], [0x20, 0x20]]).astype(np.uint8)
                mine, _ = trigrams(short, np.array([0, len(short)]))
            chosen, share = mixture(mine, probabilities)
            best = int(np.argmax(share))
            out.append((langs[chosen[best]], float(min(1.0, share[best])), len(chosen)))
    return list(zip(*out, strict=True)) or [(), (), ()]


def predict(docs: DataFrame, langs: list[str], probabilities: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_languages."""
    sent = docs.sparkSession.sparkContext.broadcast((langs, probabilities))

    def run(batches):
        for batch in batches:
            named, scores, sizes = _batch_mixtures(batch.column(2), *sent.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(named, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int32())],
                ["doc_id", "held_out", "lang_pred", "score", "n_languages"],
            )

    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(held_out(docs["doc_id"]), F.lit(False)).alias("held_out"),
        "text",
    ).mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double, n_languages int")


def with_language(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, unchanged, whose text has a language; if none could be learnt, a letter."""
    langs, probabilities = fit(training(docs))
    sent = docs.sparkSession.sparkContext.broadcast((langs, probabilities))

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            if sent.value[0]:
                named, _, _ = _batch_mixtures(column, *sent.value)
                keep = [x != UNKNOWN for x in named]
            else:
                keep = [bool(_LETTER.search(x or "")) for x in column.to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def training(docs: DataFrame) -> DataFrame:
    return docs.where(~F.coalesce(held_out(docs["doc_id"]), F.lit(False)))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled documents that are not held out, then predict all."""
    return predict(docs, *fit(training(docs)))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))
