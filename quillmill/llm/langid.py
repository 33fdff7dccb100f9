"""Language mixtures by expectation-maximisation over n-gram likelihoods.

Learning: every language gets a distribution of character n-grams of its words
(with a mark at both ends), hashed into a fixed number of buckets and smoothed.
It is learned from a bounded sample of labelled texts: at most about
``docs_per_language`` of each language, picked by a hash of id and text. The model has
one row of 2^``bits`` counters for each learned language; languages are taken to be as
few as languages are.

Prediction: words (runs of letters with their marks) are the observations. A word's likelihood under
a language is that of its n-grams. The document's proportions are fitted by
expectation-maximisation. The language set is selected by penalised likelihood
(BIC): starting from all languages the least one is taken out again and again,
every nested set is fitted anew, and the set with the best likelihood less
(size - 1) / 2 * ln(words) stays. The prediction is the largest proportion in it,
and the score is that proportion.

Words are looked up once per batch of texts, and the EM steps run over the distinct
words of each document with their counts, so memory follows a text's vocabulary and
not its length.

Defined results: ``und`` with score 0 if text is null or has no letter, or if
nothing was learned. Rows are predicted one by one, so repeats and null ids are as
good as others. Languages with equal proportions are taken by name. A row whose
lang is null is not learned from. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import filled_text
from .shingles import mix, sliced

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageConfig:
    n: int = 3  #: characters of an n-gram
    bits: int = 16  #: of the hashed n-gram table
    docs_per_language: int = 4000  #: bound of the sample that is learned from
    smoothing: float = 0.5
    steps: int = 8  #: of expectation-maximisation, per language set
    word_chars: int = 40  #: longer words are looked at in pieces of this length
    floor: float = 1e-4  #: a proportion's least value while it is fitted


@dataclass(frozen=True)
class LanguageModel:
    names: tuple[str, ...]
    logs: np.ndarray  #: ln P(n-gram bucket | language), buckets x languages
    config: LanguageConfig


def _words(texts: pa.Array, c: LanguageConfig) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-case words, the code of every word of texts, and its text's number."""
    import pyarrow.compute as pc

    blank = pa.scalar(" ", pa.large_string())
    lower = pc.binary_join_element_wise(blank, pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), pa.scalar("", pa.large_string()))
    lists = pc.split_pattern_regex(lower, r"[^\p{L}\p{M}]+\p{M}*")  # a word begins with a letter
    words = lists.flatten()
    of = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets)))
    full = np.asarray(pc.binary_length(words)) > 0
    coded = pc.dictionary_encode(words.filter(pa.array(full)))
    distinct, codes, of = coded.dictionary.to_pylist(), np.asarray(coded.indices), of[full]
    if any(len(w) > c.word_chars for w in distinct):
        pieces = [[w[k : k + c.word_chars] for k in range(0, len(w), c.word_chars)] for w in distinct]
        first = np.cumsum([0, *map(len, pieces)])
        each = np.array([len(p) for p in pieces])[codes]
        inside = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        codes, of = np.repeat(first[codes], each) + inside, np.repeat(of, each)
        distinct = [x for p in pieces for x in p]
    return distinct, codes, of


def _grams(words: list[str], c: LanguageConfig) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of words, and the number of their word."""
    sizes = np.array([len(w) for w in words], np.int64) + 2
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    h = np.zeros(max(len(points) - c.n + 1, 0), np.uint64)
    for j in range(c.n):
        h = h * np.uint64(0x100000001B3) + points[j : len(h) + j]
    of = np.repeat(np.arange(len(words)), sizes)[: len(h)]
    inside = np.arange(len(h)) + c.n <= ends[of]
    return (mix(h[inside]) >> np.uint64(64 - c.bits)).astype(np.int64), of[inside]


def learn(labelled: DataFrame, c: LanguageConfig = LanguageConfig()) -> LanguageModel:
    """From the columns doc_id, text and lang."""
    rows = labelled.where("lang IS NOT NULL").select("doc_id", filled_text().alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = rows.groupBy(F.col("lang").alias("of")).agg(F.least(F.lit(1.0), c.docs_per_language / F.count("*")).alias("share"))
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1_000_000)) < F.col("share") * 1_000_000
    sample = rows.join(F.broadcast(sizes), F.col("lang") == F.col("of")).where(drawn).select("lang", "text")  # a row per language
    space = 1 << c.bits

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column("lang").to_pylist(), object)
            for start, texts in sliced(b.column("text")):
                distinct, codes, of = _words(texts, c)
                if not distinct:
                    continue
                grams, word = _grams(distinct, c)
                mine = langs[start : start + len(texts)][of]
                for lang in set(mine):
                    n = np.bincount(codes[mine == lang], minlength=len(distinct))
                    total[lang] = total.get(lang, 0) + np.bincount(grams, weights=n[word], minlength=space)
        for lang, t in total.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(t[at].astype(np.int64))], ["lang", "bucket", "n"])

    sums = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = tuple(sorted(set(sums["lang"])))
    counts = np.zeros((space, len(names)))
    for k, name in enumerate(names):
        own = sums[sums["lang"] == name]
        counts[own["bucket"].to_numpy(), k] = own["n"].to_numpy()
    return LanguageModel(names, np.log((counts + c.smoothing) / (counts.sum(axis=0) + c.smoothing * space)), c)


def _fit(likely: np.ndarray, n: np.ndarray, doc: np.ndarray, starts: np.ndarray, n_words: np.ndarray, allowed: np.ndarray, c: LanguageConfig) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log likelihood of every document; its distinct words stand together from starts on, n times each."""
    pi = allowed / allowed.sum(axis=1, keepdims=True)
    for step in range(c.steps + 1):
        joint = likely * pi[doc]
        total = joint.sum(axis=1)
        if step == c.steps:
            return pi, np.add.reduceat(n * np.log(total), starts)
        joint *= (n / total)[:, None]
        pi = np.add.reduceat(joint, starts, axis=0) / n_words[:, None]
        pi = np.maximum(pi, c.floor) * allowed
        pi /= pi.sum(axis=1, keepdims=True)


def mixtures(texts: pa.Array, model: LanguageModel) -> np.ndarray:
    """Proportions of every text over model.names, 0 for languages that were not selected; all 0 without letters."""
    c, n_langs = model.config, len(model.names)
    out = np.zeros((len(texts), n_langs))
    distinct, codes, of = _words(texts, c)
    if not distinct or not n_langs:
        return out
    grams, word = _grams(distinct, c)
    table = np.zeros((len(distinct), n_langs))
    for k in range(n_langs):
        table[:, k] = np.bincount(word, weights=model.logs[grams, k], minlength=len(distinct))
    top = table.max(axis=1)
    pairs, n = np.unique(of * len(distinct) + codes, return_counts=True)
    of, codes = np.divmod(pairs, len(distinct))
    likely = np.maximum(np.exp(table - top[:, None]), 1e-30)[codes]
    present, starts, doc = np.unique(of, return_index=True, return_inverse=True)
    n_words, base = np.add.reduceat(n, starts), np.add.reduceat(n * top[codes], starts)
    allowed = np.ones((len(present), n_langs))
    best, best_bic = np.zeros((len(present), n_langs)), np.full(len(present), -np.inf)
    for size in range(n_langs, 0, -1):
        pi, logl = _fit(likely, n, doc, starts, n_words, allowed, c)
        bic = logl + base - (size - 1) / 2 * np.log(n_words)
        better = bic >= best_bic  # of equals the smaller set
        best[better], best_bic = pi[better], np.maximum(bic, best_bic)
        allowed[np.arange(len(present)), np.where(allowed > 0, pi, np.inf).argmin(axis=1)] = 0
    out[present] = best
    return out


def predicted(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, lang_pred, score and n_langs (languages selected), from text alone."""
    rows = docs.select(*keep, filled_text().alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size a language

    def run(batches):
        m = shared.value
        names = np.array([*m.names, UNKNOWN], object)
        for b in batches:
            for start, texts in sliced(b.column("__text")):
                pi = mixtures(texts, m)
                score = pi.max(axis=1, initial=0)
                top = np.where(score > 0, pi.argmax(axis=1) if len(m.names) else 0, len(m.names))
                part = b.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(names[top], pa.string()), pa.array(np.minimum(score, 1.0)), pa.array((pi > 0).sum(axis=1), pa.int32())], [*keep, "lang_pred", "score", "n_langs"])

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double, n_langs int")


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: the CRC-32 of its id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predict_held_out(docs: DataFrame, c: LanguageConfig = LanguageConfig()) -> DataFrame:
    """doc_id, held_out, lang_pred, score of all documents; learned from those not held out."""
    model = learn(docs.where(~held_out()), c)
    return predicted(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_langs")
