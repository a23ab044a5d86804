"""Toxicity by compression distance: what a dictionary of toxic text saves over one of ordinary text.

Two zstandard dictionaries are made: one trained on windows of ordinary texts, one of the commonest parts of toxic texts that ordinary
texts hardly have. Both compressors hold the ordinary dictionary, and one of them the toxic part in front of it, so that
the length difference of a window is what the toxic part saves. How many windows of a text, and what share, pass each of a row of
thresholds is turned into a probability by a logistic curve, fitted on labelled texts that no dictionary has seen. Windows have two lengths: in long
ones the ordinary dictionary takes hold, in short ones a single part shows.

Training reads a bounded sample of labelled rows: ``Settings.max_toxic`` and ``Settings.max_ordinary`` rows in the order of a hash
of their id, texts of ``Settings.max_train_chars`` at most. Scoring reads every text whole, a batch at a time in each task.

Defined cases: a null or empty text has no window and gets the score of a text without any saving; a null id counts as held out; labels that
are null are skipped, and without labels of both classes every score is the rate of toxic labels (0 without labels). Repeated rows are
scored each for itself. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLDS = (1, 2, 3, 4, 5, 6)
PENALTY = 2e-3


@dataclass(frozen=True)
class Settings:
    max_toxic: int = 1500
    max_ordinary: int = 3000
    max_train_chars: int = 50_000
    level: int = 6
    ordinary_bytes: int = 16384
    toxic_bytes: int = 2048
    #: Lengths of windows in words, and by how many words the next one starts later. Dictionaries are trained on windows of the first kind.
    windows: tuple[tuple[int, int], ...] = ((8, 6), (4, 3))
    #: Lengths in bytes of the parts of words that are compared, how much more often toxic texts must hold one, and how surely (log-likelihood ratio).
    grams: tuple[int, ...] = (5, 6, 7, 8, 9, 10)
    min_lift: float = 20.0
    min_evidence: float = 25.0
    seed: int = 0


@dataclass(frozen=True)
class Model:
    """What tasks need: two dictionaries, feature scales, coefficients; about 20 kB."""

    ordinary: bytes
    toxic: bytes
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    coefficients: tuple[float, ...]
    settings: Settings


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").split()


def _windows(words: list[bytes], length: int, step: int) -> list[bytes]:
    last = max(1, len(words) - length + step)
    return [b" " + b" ".join(words[i : i + length]) + b" " for i in range(0, last, step)] if words else []


def _grams(word: bytes, lengths: tuple[int, ...]) -> set[bytes]:
    word = b" " + word + b" "
    return {word[i : i + n] for n in lengths for i in range(len(word) - n + 1)}


def _evidence(bad: int, good: int, n_bad: int, n_good: int) -> float:
    """Log-likelihood ratio of the two shares being different."""
    share = n_bad / (n_bad + n_good)
    part = lambda seen, wanted: seen * math.log(seen / wanted) if seen else 0.0
    return 2 * (part(bad, (bad + good) * share) + part(good, (bad + good) * (1 - share)))


def _marks(toxic: list[list[bytes]], ordinary: list[list[bytes]], s: Settings) -> set[bytes]:
    """Parts of words, with their edges, found in far more toxic than ordinary texts, however small the share of texts (a language, say) that has them.

    Of parts that hold one another only the shorter ones are needed.
    """
    seen = []
    for texts in (toxic, ordinary):
        count: Counter = Counter()
        for words in texts:
            count.update(set().union(*(_grams(w, s.grams) for w in set(words))) if words else ())
        seen.append(count)
    lift = lambda g: (seen[0][g] + 0.5) / (len(toxic) + 1) / ((seen[1][g] + 0.5) / (len(ordinary) + 1))
    found = sorted((
        g for g, n in seen[0].items()
        if n >= 2 and lift(g) >= s.min_lift and _evidence(n, seen[1][g], len(toxic), len(ordinary)) >= s.min_evidence), key=len)
    marks: set[bytes] = set()
    for g in found:
        if not any(g[i : i + n] in marks for n in s.grams if n < len(g) for i in range(len(g) - n + 1)):
            marks.add(g)
    return marks


def _marked_part(word: bytes, marks: set[bytes], lengths: tuple[int, ...]) -> bytes:
    word = b" " + word + b" "
    inside = set()
    for n in lengths:
        for i in range(len(word) - n + 1):
            if word[i : i + n] in marks:
                inside.update(range(i, i + n))
    return bytes(word[i] for i in sorted(inside))


def _dictionary(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _commonest(parts: list[bytes], size: int) -> bytes:
    """The commonest parts as dictionary content, the most common at the end, where matches cost least."""
    chosen, held = [], 0
    for part, _ in sorted(Counter(parts).items(), key=lambda x: (-x[1], x[0])):
        if held + len(part) > size:
            break
        if not any(part in c for c in chosen):
            chosen.append(part)
            held += len(part)
    return b"".join(reversed(chosen))


def _saver(model_ordinary: bytes, model_toxic: bytes, level: int) -> Callable[[bytes], int]:
    """Bytes that the toxic part saves on a window."""
    packers = []
    for content in (model_ordinary, model_toxic + model_ordinary):
        shared = None
        if len(content) >= 8:
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=level)
        packers.append(zstandard.ZstdCompressor(
            dict_data=shared, level=level, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
    plain, marked = packers
    return lambda window: len(plain(window)) - len(marked(window))


def _features(text: str | None, save: Callable[[bytes], int], s: Settings) -> list[float]:
    words, out = _words(text), []
    for length, step in s.windows:
        saved = Counter(save(w) for w in _windows(words, length, step))
        n = max(1, sum(saved.values()))
        over = [sum(m for v, m in saved.items() if v >= t) for t in THRESHOLDS]
        out += [*np.log1p(over), *(np.sqrt(o / n) for o in over), np.log1p(n), float(max([0, *saved]))]
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted, regularised logistic regression by Newton steps; features of neighbouring thresholds say nearly the same."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        curve = x.T @ (x * (weight * q * (1 - q))[:, None]) + np.eye(len(b)) * PENALTY
        b = b + np.linalg.solve(curve, x.T @ (weight * (y - q)) - PENALTY * b)
    return b


def fit(toxic: list[str], ordinary: list[str], rate: float, settings: Settings = Settings()) -> Model | float:
    """The model for these texts, or the constant ``rate`` of toxic labels where a class has fewer than three texts."""
    s = settings
    if min(len(toxic), len(ordinary)) < 3:
        return rate
    part = lambda texts, calibrate: [t for i, t in enumerate(texts) if (i % 3 == 2) == calibrate]
    rng = np.random.default_rng(s.seed)
    bad, good = ([_words(t) for t in part(x, False)] for x in (toxic, ordinary))
    marks = _marks(bad, good, s)
    marked = [m for words in bad for w in words if (m := _marked_part(w, marks, s.grams))]
    plain = [w for words in good for w in _windows(words, *s.windows[0])]
    pick = lambda items, n: [items[i] for i in rng.permutation(len(items))[:n]]
    dictionary = _dictionary(pick(plain, 80_000), s.ordinary_bytes, 32, 8)
    extra = _commonest(marked, s.toxic_bytes)
    save = _saver(dictionary, extra, s.level)
    x = np.array([_features(t, save, s) for t in (*part(toxic, True), *part(ordinary, True))])
    n_bad, n_good = len(part(toxic, True)), len(part(ordinary, True))
    y = np.repeat([1.0, 0.0], [n_bad, n_good])
    weight = np.repeat([rate / n_bad, (1 - rate) / n_good], [n_bad, n_good])
    centre, scale = x.mean(0), x.std(0) + 1e-9
    b = _logistic(np.column_stack([np.ones(len(x)), (x - centre) / scale]), y, weight)
    return Model(dictionary, extra, tuple(centre), tuple(scale), tuple(b), s)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | float:
    """Fits on labelled rows that are not held out. Only the ids of the bounded sample are sent to the tasks that read ``docs``."""
    usable = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rate = counts.get(1, 0) / max(1, counts.get(1, 0) + counts.get(0, 0))
    texts = {}
    for label, most in ((1, settings.max_toxic), (0, settings.max_ordinary)):
        ids = usable.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id")
        rows = (
            docs.select("doc_id", "text").where(F.length("text").between(1, settings.max_train_chars))
            .join(F.broadcast(ids.distinct()), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).collect()  # one row per id
        )
        texts[label] = list(dict.fromkeys(r["text"] for r in sorted(rows, key=lambda r: (str(r["doc_id"]), r["text"]))))[: most]
    return fit(texts[1], texts[0], rate, settings)


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    rows = docs.select("doc_id", "text")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if isinstance(model, Model):
            save = _saver(model.ordinary, model.toxic, model.settings.level)
            centre, scale, b = (np.array(v) for v in (model.centre, model.scale, model.coefficients))
        for batch in batches:
            if isinstance(model, Model):
                x = np.array([_features(t.as_py(), save, model.settings) for t in batch.column("text")]).reshape(-1, len(centre))
                p = 1 / (1 + np.exp(-np.clip(b[0] + ((x - centre) / scale) @ b[1:], -30, 30)))
            else:
                p = np.full(batch.num_rows, float(model))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    scored = rows.mapInArrow(run, schema)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
