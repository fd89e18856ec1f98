"""Toxicity: a linear-chain conditional random field tags toxic spans, its marginals score documents.

Labels are given for documents. On a bounded sample of labelled documents, words that occur in many toxic and hardly
any clean ones label the tokens; the field (features: the word, the word before, the word after, and the transition
between tags) is fitted to them by gradient steps on the log likelihood. A sequence is a sentence. For
every text, forward and backward messages give the probability of each token to be toxic. The document score is a
logistic function, fitted on the sampled documents, of the largest probability and of the expected number of toxic
tokens; runs of tokens with a probability of one half or more are the offending spans.

The words that have features are kept as a sorted array of their 64-bit hashes, bounded by the sample; every other
word is unknown, so no word takes the weight of another one.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.shared import blocks, joined_bytes, ragged, remainder, whole_texts
from siftline.llm.words import PLAIN, word_hashes, word_spans

#: Documents of the sample: toxic and clean ones, those with the smallest hash of their id.
TOXIC_SAMPLE, CLEAN_SAMPLE = 1000, 3000
#: A word labels tokens if it is so many times as frequent in toxic as in clean sampled documents, it is in so many
#: documents at least, and the log likelihood ratio (G squared) of its two frequencies is significant for as many
#: words as were tried: of the words that pass, this share is expected to pass by chance (Benjamini and Hochberg).
#: So the limit follows from the sample, small ones included.
ODDS, LEAST, FALSE_SHARE = 20.0, 3, 0.05
#: The largest score of a model that found no word to go by.
NO_EVIDENCE = 0.49
#: Words in fewer sampled texts count as unknown.
RARE = 5
CLEAN_SENTENCES = 40_000
#: Texts of the sample are read so many at a time.
PART = 200
#: Steps; the rate for a word itself and, smaller, for its neighbours; decay.
STEPS, RATE, NEAR_RATE, DECAY = 60, 0.5, 0.05, 1e-3
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n\r")] = True


@dataclass
class Tokens:
    """The tokens of some texts: features, place and sentences."""

    hashes: np.ndarray
    texts: np.ndarray  # n + 1 offsets of the texts in the tokens
    start: np.ndarray  # characters of all texts one after another
    end: np.ndarray
    chars: np.ndarray  # n + 1 offsets of the texts in the characters
    sentences: np.ndarray  # m + 1 offsets of the sentences in the tokens


def tokens_of(texts: pa.Array) -> Tokens:
    """Words are runs of ASCII letters, digits and characters beyond ASCII, in lower case."""
    data, offsets = joined_bytes(pc.utf8_lower(whole_texts(texts)))
    starts, ends, words = word_spans(data, offsets, PLAIN)
    chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    stops = np.r_[0, np.cumsum(_ENDS[data])]
    new = np.zeros(len(starts) + 1, bool)
    new[words] = True
    if len(starts):
        new[1:-1] |= stops[starts[1:]] > stops[ends[:-1]]
        new[0] = new[-1] = True
    return Tokens(word_hashes(data, starts, ends), words, chars[starts], chars[ends], chars[offsets],
                  np.flatnonzero(new) if len(starts) else np.zeros(1, np.int64))


def features(tokens: Tokens, known: np.ndarray) -> np.ndarray:
    """Numbers of the word, the word before and the word after. With v ``known`` words (sorted hashes): 0 to v - 1 the
    word, v any other word, from v + 1 the word before, from 2v + 1 the word after, 3v + 1 none (beyond a sentence, or
    a neighbour that is not known)."""
    v = len(known)
    own = np.full(len(tokens.hashes), v, np.int32)
    if v:
        at = np.minimum(np.searchsorted(known, tokens.hashes), v - 1)
        own = np.where(known[at] == tokens.hashes, at, v).astype(np.int32)
    out = np.full((len(own), 3), 3 * v + 1, np.int32)
    out[:, 0] = own
    if len(own):
        first = np.zeros(len(own), bool)
        first[tokens.sentences[:-1]] = True
        inner = np.flatnonzero(~first)
        after = inner[own[inner] < v]
        before = inner[own[inner - 1] < v]
        out[before, 1] = v + 1 + own[before - 1]
        out[after - 1, 2] = 2 * v + 1 + own[after]
    return out


@dataclass
class Field:
    """weights: toxic less clean, for each feature (the last is none); bias; transition[i, j] from tag i to tag j."""

    weights: np.ndarray
    bias: float
    transition: np.ndarray
    scale: np.ndarray  # of the document score: constant, largest probability, expected number
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted hashes of the words with features

    def marginals(self, given: np.ndarray, sentences: np.ndarray, pairs: bool = False):
        """Probability of each token to be toxic; with ``pairs`` also the expected transitions."""
        u = self.weights[given].sum(axis=1) + self.bias
        t = self.transition
        sizes = np.diff(sentences)
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = sentences[:-1][order], sizes[order]
        forward, backward = u.copy(), np.zeros_like(u)
        longest = int(sizes[0]) if len(sizes) else 0
        live = np.searchsorted(-sizes, -np.arange(longest), "left")
        for k in range(1, longest):
            at = starts[: live[k]] + k
            x = forward[at - 1]
            forward[at] += np.logaddexp(t[0, 1], t[1, 1] + x) - np.logaddexp(t[0, 0], t[1, 0] + x)
        for k in range(longest - 2, -1, -1):
            at = starts[: live[k + 1]] + k
            y = u[at + 1] + backward[at + 1]
            backward[at] = np.logaddexp(t[1, 0], t[1, 1] + y) - np.logaddexp(t[0, 0], t[0, 1] + y)
        p = 1 / (1 + np.exp(-np.clip(forward + backward, -500, 500)))
        if not pairs:
            return p
        inner = np.ones(len(u), bool)
        inner[sentences[:-1]] = False
        at = np.flatnonzero(inner)
        logs = np.stack([t[i, j] + i * forward[at - 1] + j * (u[at] + backward[at]) for i in (0, 1) for j in (0, 1)])
        logs -= logs.max(axis=0)
        share = np.exp(logs)
        return p, (share / share.sum(axis=0)).sum(axis=1).reshape(2, 2)

    def documents(self, p: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Document scores from the marginals of their tokens; a text without tokens has none that is toxic."""
        return 1 / (1 + np.exp(-_evidence(p, texts) @ self.scale))


def _evidence(p: np.ndarray, texts: np.ndarray) -> np.ndarray:
    top, total = np.zeros(len(texts) - 1), np.zeros(len(texts) - 1)
    full = np.flatnonzero(texts[1:] > texts[:-1])
    if len(full):
        top[full] = np.maximum.reduceat(p, texts[:-1][full])
        total[full] = np.add.reduceat(np.where(p >= 0.1, p, 0.0), texts[:-1][full])
    return np.stack([np.ones(len(top)), top, np.log1p(total)], axis=1)


def _tokens_in_parts(texts: list[str]) -> Tokens:
    """Hashes, texts and sentences of all texts; the places in the characters are left out."""
    hashes, sizes, sentences = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for low in range(0, len(texts), PART):
        own = tokens_of(pa.array(texts[low: low + PART], pa.large_string()))
        hashes.append(own.hashes)
        sizes.append(np.diff(own.texts))
        sentences.append(np.diff(own.sentences))
    none = np.zeros(0, np.int64)
    return Tokens(np.concatenate(hashes), np.r_[0, np.cumsum(np.concatenate(sizes))], none, none, none, np.r_[0, np.cumsum(np.concatenate(sentences))])


def _significant(evidence: np.ndarray, tried: np.ndarray) -> np.ndarray:
    """Which of the words that are ``tried`` have a G squared too large for chance."""
    kinds, which = np.unique(np.round(np.maximum(evidence, 0.0), 9), return_inverse=True)
    chance = np.array([math.erfc(math.sqrt(g / 2)) / 2 for g in kinds])[which] if len(kinds) else np.zeros(0)
    ordered = np.sort(chance[tried])
    passed = np.flatnonzero(ordered <= FALSE_SHARE * np.arange(1, len(ordered) + 1) / max(1, len(ordered)))
    return tried & (chance <= ordered[passed[-1]]) if len(passed) else np.zeros(len(chance), bool)


def fit(texts: list[str], toxic: np.ndarray) -> Field:
    """Fit to whole labelled texts (a bounded sample). Without toxic or without clean ones every score is the share
    of toxic ones (0 without any); if no word tells toxic from clean ones it is that share too, but below one half."""
    none = Field(np.zeros(2), -20.0, np.zeros((2, 2)), np.array([0.0, 0.0, 0.0]))
    toxic = np.asarray(toxic, bool)
    if not len(toxic) or toxic.all() or not toxic.any():
        none.scale[0] = 20.0 if len(toxic) and toxic.all() else -20.0
        return none
    tokens = _tokens_in_parts(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(tokens.texts))
    # copies count once
    once = np.zeros(len(texts), bool)
    once[list({t: k for k, t in enumerate(texts)}.values())] = True
    words, word = np.unique(tokens.hashes, return_inverse=True)
    pair = np.unique(word[once[owner]] * np.int64(len(texts)) + owner[once[owner]])
    in_toxic = toxic[pair % len(texts)]
    df = [np.bincount(pair[in_toxic == k] // len(texts), minlength=len(words)) for k in (False, True)]
    n = [int((once & (toxic == k)).sum()) for k in (False, True)]
    ratio = ((df[1] + 0.5) / (n[1] + 1)) / ((df[0] + 0.5) / (n[0] + 1))
    mean = (df[0] + df[1]) / (n[0] + n[1])
    evidence = sum(2 * k * np.log(np.maximum(k, 1) / np.maximum(size * mean, 1e-12)) for k, size in zip(df, n))
    marked = (ratio >= ODDS) & _significant(evidence, (df[0] + df[1]) >= LEAST)
    if not marked.any():
        share = min(float(toxic.mean()), NO_EVIDENCE)
        none.scale[0] = math.log(share / (1 - share))
        return none
    labels = marked[word] & toxic[owner]
    # sentences with a toxic token, and as many of the others as are wanted, those of clean texts first in order
    sizes = np.diff(tokens.sentences)
    hot = np.add.reduceat(labels, tokens.sentences[:-1]) > 0 if len(sizes) else np.zeros(0, bool)
    cold = np.flatnonzero(~hot)
    cold = cold[np.argsort(tokens.hashes[tokens.sentences[:-1][cold]], kind="stable")[:CLEAN_SENTENCES]]
    chosen = np.sort(np.r_[np.flatnonzero(hot), cold])
    # words in few sampled texts share one weight, which then stands for all words the sample lacks
    known = words[(df[0] + df[1] >= RARE) | marked]
    index = ragged(tokens.sentences[:-1][chosen], sizes[chosen])
    model = _ascend(features(tokens, known)[index], labels[index].astype(float), np.r_[0, np.cumsum(sizes[chosen])], known)
    # the document score, on all sampled texts
    parts = []
    for low in range(0, len(texts), PART):
        own = tokens_of(pa.array(texts[low: low + PART], pa.large_string()))
        parts.append(_evidence(model.marginals(features(own, known), own.sentences), own.texts))
    seen = np.concatenate(parts)
    scale = np.zeros(3)
    weight = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum()) * len(toxic)
    for _ in range(50):
        q = 1 / (1 + np.exp(-seen @ scale))
        slope = seen.T @ (weight * (toxic - q)) - 0.1 * scale
        curve = (seen * (weight * q * (1 - q))[:, None]).T @ seen + 0.1 * np.eye(3)
        scale += np.linalg.solve(curve, slope)
    model.scale = scale
    return model


def _ascend(x: np.ndarray, y: np.ndarray, cuts: np.ndarray, known: np.ndarray) -> Field:
    """Adaptive gradient steps on the log likelihood of the tags ``y``."""
    size = 3 * len(known) + 2
    model = Field(np.zeros(size), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), np.zeros((2, 2)), np.zeros(3), known)
    inner = np.ones(len(y), bool)
    inner[cuts[:-1]] = False
    at = np.flatnonzero(inner)
    seen = np.bincount((2 * y[at - 1] + y[at]).astype(int), minlength=4).reshape(2, 2)
    used, flat = np.unique(x.ravel(), return_inverse=True)
    counts = np.bincount(flat)
    rates = np.where(used <= len(known), RATE, NEAR_RATE)
    squares = [np.full(len(used), 1e-8), 1e-8, np.full((2, 2), 1e-8)]
    for _ in range(STEPS):
        p, expected = model.marginals(x, cuts, pairs=True)
        rest = y - p
        slope = np.bincount(flat, np.repeat(rest, 3), minlength=len(used)) / np.sqrt(counts) - DECAY * model.weights[used]
        slope[used == size - 1] = 0
        squares[0] += slope * slope
        model.weights[used] += rates * slope / np.sqrt(squares[0])
        slope = rest.sum() / len(y)
        squares[1] += slope * slope
        model.bias += float(RATE * slope / np.sqrt(squares[1]))
        slope = (seen - expected) / len(y)
        squares[2] += slope * slope
        model.transition += RATE * slope / np.sqrt(squares[2])
    return model


def sample(docs: DataFrame, labels: DataFrame, toxic_sample: int = TOXIC_SAMPLE, clean_sample: int = CLEAN_SAMPLE) -> tuple[list[str], np.ndarray]:
    """Texts and labels of a bounded number of labelled documents that may be learned from (crc32 of the id modulo 5
    is not 0): of each label those with the smallest hash of their id. Null texts and labels are left out."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    known = known.where(remainder("doc_id", 5) != 0)
    chosen = None
    for value, size in ((1, toxic_sample), (0, clean_sample)):
        part = known.where((F.col("__toxic") > 0) == (value == 1)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
        chosen = part if chosen is None else chosen.unionAll(part)
    picked = chosen.select(F.col("doc_id").alias("__id"), "__toxic")
    rows = (docs.select(F.col("doc_id").alias("__doc"), F.col("text").cast("string").alias("__text")).where("__text is not null")
            
            .join(F.broadcast(picked), F.col("__doc") == F.col("__id")).groupBy("__id").agg(F.min("__text").alias("text"), F.max("__toxic").alias("toxic")))
    found = rows.orderBy("__id").toArrow()
    return found["text"].to_pylist(), found["toxic"].to_numpy() > 0


def score_documents(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score, spans (array of start and end in characters of the lower-cased text, and the largest
    probability) of every row. Null and empty texts have no token and the score of a text without evidence; repeated
    rows each get a row; only doc_id and text are read. Nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for block in blocks(batches, "text"):
            tokens = tokens_of(block.column("text"))
            p = own.marginals(features(tokens, own.known), tokens.sentences)
            score = own.documents(p, tokens.texts)
            hot = np.flatnonzero(p >= 0.5)
            owner = np.searchsorted(tokens.texts, hot, "right") - 1
            new = np.r_[True, (hot[1:] != hot[:-1] + 1) | (owner[1:] != owner[:-1])] if len(hot) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(hot)] - 1
            base = tokens.chars[owner[first]] if len(first) else np.zeros(0, np.int64)
            spans = pa.StructArray.from_arrays([
                pa.array(tokens.start[hot[first]] - base, pa.int64()), pa.array(tokens.end[hot[last]] - base if len(first) else base, pa.int64()),
                pa.array(np.maximum.reduceat(p[hot], first) if len(first) else np.zeros(0), pa.float64())], names=["start", "end", "probability"])
            places = np.searchsorted(owner[first] if len(first) else np.zeros(0, np.int64), np.arange(len(block) + 1))
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(score), pa.ListArray.from_arrays(pa.array(places, pa.int32()), spans)],
                names=["doc_id", "score", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, score double, spans array<struct<start: long, end: long, probability: double>>")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; a fifth of the documents is held out."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_documents(docs, fit(*sample(docs, labels)))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
