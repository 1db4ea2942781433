"""Extractive summaries that need more than one row's worth of expression: per-document TF-IDF."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmill.functions import text as tx
from pairmill.operators.columns import compute_once

# Equal scores are such that agree in this many digits.
TIE_DIGITS = 9


def sentence_scores(terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF scores of all sentences of a batch of documents (lists of lists of terms).

    Returns the number of the first sentence of each document and one past its last, and the scores. Terms become numbers
    by one dictionary for the batch; counts are runs in sorted arrays of (sentence, term), so nothing is done per term.
    """
    if not len(terms) or not len(terms.values):
        # Arrow leaves the offsets of empty lists open.
        none = np.zeros(len(terms), np.int64)
        return none, none, np.zeros(0)
    documents, sentences = terms.offsets.to_numpy(), terms.values.offsets.to_numpy()
    per_document, per_sentence = np.diff(documents), np.diff(sentences)
    words = terms.values.values
    words = words.slice(sentences[0], sentences[-1] - sentences[0])
    code = pc.dictionary_encode(words).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # Sentences and documents that the terms stand in. The child arrays may begin before the first document.
    sentence = np.repeat(np.arange(len(per_sentence)), per_sentence)
    document = np.full(len(per_sentence), -1)
    document[documents[0] : documents[-1]] = np.repeat(np.arange(len(per_document)), per_document)
    size = int(code.max()) + 1 if len(code) else 1
    # (sentence, term) with counts, then the number of sentences of each (document, term).
    pair, count = np.unique(sentence * size + code, return_counts=True)
    at, term = pair // size, pair % size
    _, where, spread = np.unique(document[at] * size + term, return_inverse=True, return_counts=True)
    weight = count * (np.log((1 + per_document[document[at]]) / (1 + spread[where])) + 1)
    total = np.bincount(at, weight, len(per_sentence))
    length = np.sqrt(np.bincount(at, weight * weight, len(per_sentence)))
    return documents[:-1], documents[1:], np.divide(total, length, out=np.zeros_like(total), where=length > 0)


def best_sentences(terms: Column, n: int) -> Column:
    """Places of the ``n`` best sentences in text order, from the terms of each sentence; equal scores: the later one. Empty
    if no sentence has a term, NULL for NULL."""

    @F.arrow_udf("array<int>")
    def best(batch: pa.Array) -> pa.Array:
        starts, ends, scores = sentence_scores(batch)
        scores = np.round(scores, TIE_DIGITS)
        found: list[list[int] | None] = []
        for valid, i, j in zip(batch.is_valid().to_pylist(), starts, ends):
            one = scores[i:j]
            first = np.lexsort((-np.arange(j - i), -one))[:n] if valid and one.any() else one[:0].astype(int)
            found.append(np.sort(first).tolist() if valid else None)
        return pa.array(found, pa.list_(pa.int32()))

    # Else a filter on the summary would run it twice.
    return best.asNondeterministic()(terms)


def tfidf_summary(df: DataFrame, text: str = "text", n: int = 3, name: str = "summary") -> DataFrame:
    """Add the ``n`` highest scoring sentences of each text, in text order, joined by ``'. '``. Map-only.

    A TF-IDF model is fitted on each document alone: its sentences are the model's documents. Weight of a term
    in a sentence: count * (ln((1 + sentences) / (1 + sentences with the term)) + 1); a sentence scores the
    sum of its weights after scaling the row to unit length. Equal scores: the later sentence wins. Texts of
    at most ``n`` sentences are returned whole, joined by a space; more sentences without any term give ''.

    Sentences and terms are cut by built-in functions; only the terms of texts with more than ``n`` sentences go to Python,
    in Arrow batches, and only places of sentences come back. All columns pass through, rows without an id as well.
    """
    cut = compute_once(df, __pm_sentences=tx.summary_sentences(text))
    sentences = F.col("__pm_sentences")
    terms = F.when(F.size(sentences) > n, F.transform(sentences, lambda s: tx.term_tokens(s)))
    cut = cut.withColumn("__pm_best", best_sentences(terms, n))
    summary = F.when(F.size(sentences) <= n, F.array_join(sentences, " ")).otherwise(
        F.array_join(F.transform("__pm_best", lambda i: F.get(sentences, i)), ". ")
    )
    return cut.withColumn(name, summary).drop("__pm_sentences", "__pm_best")
