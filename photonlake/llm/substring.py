"""Substring dedup by sliding sentence spans.

A sentence ends after ``.``, ``!`` or ``?`` before white space, or at a line's end. It is also cut after each word whose hash is the
least of some REACH words in a row, so that its parts, called sentences from here on, do not depend on where a passage stands in it, and
REACH words in a row always hold a cut. From each one the shortest run of at least SENTENCES sentences and WORDS words is hashed (A-Z
lower-cased, white space aside): any passage of ``2 * REACH + WORDS - 1`` words holds a whole run. The first place of a run
is the one of the smallest (doc_id, row hash, sentence); sentences that any other place covers go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import staged, unused
from .text import Words, mix, raw_texts, slices

SENTENCES, WORDS = 2, 20
#: Words in a row of which the one of the least hash ends a sentence.
REACH = 10
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE = np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True


def _least(w: Words) -> np.ndarray:
    """Which words have the least hash of some REACH words in a row of their text; of words as small all."""
    n = len(w.hash) - REACH + 1
    if n <= 0:
        return np.zeros(len(w.hash), bool)
    low, width = w.hash, 1
    while width < REACH:
        step = min(width, REACH - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    low = np.where(w.doc[:n] == w.doc[REACH - 1 :], low, np.uint64(0))
    # a word is the least of a window if the greatest of the minima of its windows is its own hash
    high, width = np.concatenate((np.zeros(REACH - 1, np.uint64), low, np.zeros(REACH - 1, np.uint64))), 1
    while width < REACH:
        step = min(width, REACH - width)
        high = np.maximum(high[: len(high) - step], high[step:])
        width += step
    return high == w.hash


def _sentences(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First words of all sentences, and where each text's sentences begin."""
    n = len(w.hash)
    if not n:
        return np.empty(0, np.int64), np.zeros(w.n + 1, np.int64)
    last = w.buf[w.ends - 1]
    stop = (last == 46) | (last == 33) | (last == 63)
    lines = np.cumsum((w.buf == 10) | (w.buf == 13))
    stop[:-1] |= lines[w.starts[1:]] > lines[w.ends[:-1] - 1]
    stop |= _least(w)
    first = np.flatnonzero(np.concatenate(([True], stop[:-1] | (w.doc[1:] != w.doc[:-1]))))
    return first, np.searchsorted(first, w.ptr)


def _runs(w: Words, first: np.ndarray, ptr: np.ndarray, sentences: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first sentence, sentence after the last, and hash of each run."""
    k = len(first)
    if not k:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    doc = w.doc[first]
    start = np.arange(k)
    ends = np.concatenate((first[1:], [len(w.hash)]))  # words
    stop = np.maximum(np.searchsorted(ends, first + words), start + sentences - 1) + 1
    ok = stop <= ptr[doc + 1]
    start, stop, doc = start[ok], stop[ok], doc[ok]
    power = np.full(len(w.hash) + 1, _STEP, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(w.hash * power[:-1])))
    back = np.full(len(w.hash) + 1, _INVERSE, np.uint64)
    back[0] = 1
    back = np.cumprod(back)
    a, z = first[start], ends[stop - 1]
    return doc, start - ptr[doc], stop - ptr[doc], mix((total[z] - total[a]) * back[a] + (z - a).astype(np.uint64))


def spans(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """h, doc_id, row (hash of doc_id and text), start, stop of every run, one for each text; what a text repeats of itself has a first place of -1."""

    def of(batches):
        for b in batches:
            raw = raw_texts(b.column(2))
            for a, e in slices(raw):
                w = Words(raw[a:e])
                doc, start, stop, h = _runs(w, *_sentences(w), sentences, words)
                # a run's repeats in its own text go in any case: they become merged ranges, behind a place that comes first
                order = np.lexsort((start, h, doc))
                later = np.zeros(len(h), bool)
                later[order[1:]] = (doc[order[1:]] == doc[order[:-1]]) & (h[order[1:]] == h[order[:-1]])
                d, x, z = doc[later], start[later], stop[later]
                head = np.flatnonzero(np.concatenate((np.ones(min(1, len(d)), bool), (d[1:] != d[:-1]) | (x[1:] > z[:-1]))))
                d, x, z = d[head], x[head], (np.maximum.reduceat(z, head) if len(head) else z)
                rows = b.column(1).to_numpy()[a:e]
                own = mix(mix(rows[d].view(np.uint64)) ^ (x + 1).astype(np.uint64))
                none = np.full(len(d), -1)
                doc, start, stop, h = (np.concatenate(v) for v in ((doc[~later], d, d), (start[~later], none, x), (stop[~later], none, z), (h[~later], own, own)))
                at = pa.array(doc + a)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column(0).take(at), b.column(1).take(at), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], ["h", "doc_id", "row", "start", "stop"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("string"))
    return rows.mapInArrow(of, "h long, doc_id long, row long, start int, stop int")


def substring_dedup(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """All rows and columns of docs, ``text`` without repeated runs, and _sentences_cut, _words_cut (long).

    A null text stays null, one without repeats stays as it is to the byte; n_chars, where there is one, follows a changed text. Rows equal in doc_id
    and text are one document: all of them keep or lose the same sentences. Rows without doc_id come first. A run that
    overlaps its own repeat counts as repeated. Columns of docs named _sentences_cut or _words_cut are replaced.
    """
    found = spans(docs, sentences, words)
    # most runs stand in one place: only the hashes of all of them are counted, then the rest is worked on
    often = staged(found.groupBy("h").count().where("count > 1").select("h"))
    found = staged(found.join(often, "h", "left_semi"))
    place = F.struct("doc_id", "row", "start")
    first = found.groupBy("h").agg(F.min(place).alias("p")).select("h", F.col("p.row").alias("r0"), F.col("p.start").alias("s0"))
    again = found.select("h", "row", "start", "stop").join(first, "h").where("row <> r0 or start <> s0")
    base = docs.drop("_sentences_cut", "_words_cut")
    names = base.columns
    row, cut = unused(docs, "_row"), unused(docs, "_cuts")
    cuts = again.groupBy(F.col("row").alias(row)).agg(F.collect_set(F.struct("start", "stop")).alias(cut))
    work = base.withColumn(row, F.xxhash64("doc_id", "text")).join(cuts, row, "left").select(*names, F.col(cut)["start"].alias(row), F.col(cut)["stop"].alias(cut))
    schema = base.select("*").schema.add("_sentences_cut", "long").add("_words_cut", "long")
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def of(batches):
        for b in batches:
            n, width = b.num_rows, len(names)
            columns = list(b.columns[:width])
            gone, lost = np.zeros(n, np.int64), np.zeros(n, np.int64)
            hit = np.flatnonzero(b.column(width).is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                raw = raw_texts(columns[text_at])
                texts = columns[text_at].to_pylist()
                lengths = columns[chars_at].to_pylist() if chars_at is not None else None
                starts, stops = b.column(width).take(pa.array(hit)).to_pylist(), b.column(width + 1).take(pa.array(hit)).to_pylist()
                for i, ss, zs in zip(hit.tolist(), starts, stops):
                    w = Words([raw[i]])
                    first, _ = _sentences(w)
                    cut = np.zeros(len(first) + 1, np.int64)
                    np.add.at(cut, ss, 1)
                    np.add.at(cut, zs, -1)
                    drop = np.cumsum(cut[:-1]) > 0
                    words_of = np.diff(np.concatenate((first, [len(w.hash)])))
                    at = np.concatenate((w.starts[first], [len(raw[i])]))
                    at[0] = 0
                    body = bytes(raw[i])
                    texts[i] = b"".join(body[at[j] : at[j + 1]] for j in np.flatnonzero(~drop)).decode("utf-8", "replace")
                    gone[i], lost[i] = drop.sum(), words_of[drop].sum()
                    if lengths is not None:
                        lengths[i] = len(texts[i])
                columns[text_at] = pa.array(texts, columns[text_at].type)
                if lengths is not None:
                    columns[chars_at] = pa.array(lengths, columns[chars_at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone), pa.array(lost)], [*names, "_sentences_cut", "_words_cut"])

    return work.mapInArrow(of, schema)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("_sentences_cut").alias("sentences_cut"), F.col("_words_cut").alias("words_cut"))
