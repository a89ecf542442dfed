"""Toxicity scores from subword-bag embeddings under a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sample of labelled rows: at most so many of class 0 and 1, none longer than so many code points.
SAMPLE_ROWS, SAMPLE_CHARS = (2_500, 1_500), 30_000
# Lengths of n-grams; rows and columns of the embedding table. A window is two neighbouring words, or a lone one.
GRAMS, BUCKETS, DIM = (3, 4, 5), 1 << 17, 8
# Passes over the sample, step size, decay of the embeddings, and how sharply windows are weighed at first and at last.
PASSES, RATE, DECAY, SHARP = 100, 0.02, 0.1, (0.5, 3.0)
# Words a task remembers, texts and bytes of them looked at together, and words whose n-grams are held at once.
MEMO, ROWS, BYTES, WORDS = 100_000, 256, 1 << 20, 10_000


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, word index) of all character n-grams of ``<word>`` and of the word itself, in word order."""
    marked = [f"<{w}>" for w in words]
    length = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), length)
    ends = np.cumsum(length)
    left = np.repeat(ends, length) - np.arange(len(codes))  # code points from here to the end of the word
    buckets, owners = [], []
    rolling = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(GRAMS) + 1):
            shifted = np.zeros(len(codes), np.uint64)
            shifted[:max(0, len(codes) - n + 1)] = codes[n - 1:]
            rolling = rolling * np.uint64(0x100000001B3) + shifted + np.uint64(1)
            if n in GRAMS:
                fits = left >= n
                buckets.append(_bucket(rolling[fits]))
                owners.append(owner[fits])
        # The whole word: a sum over positions that depends on their order.
        power = np.power(np.uint64(0x9E3779B97F4A7C15 | 1), (np.arange(len(codes)) - np.repeat(ends - length, length)).astype(np.uint64))
        whole = np.add.reduceat(codes * power, ends - length) if len(marked) else np.zeros(0, np.uint64)
        buckets.append(_bucket(whole))
        owners.append(np.arange(len(marked)))
    bucket, owner = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return bucket[order], owner[order]


def _bucket(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(40)).astype(np.int64) % BUCKETS


def words_of(text: str) -> list[str]:
    return text.lower().split()


@dataclass
class Model:
    """Per n-gram bucket the embedding's product with the softmax weights, class 1 minus class 0, and the bias.

    A softmax over two classes is a logistic function of that difference, and an average of embeddings has the average
    of the products, so nothing else is needed to score.
    """

    grams: np.ndarray
    bias: float

    def word_values(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        for at in range(0, len(words), WORDS):
            part = words[at:at + WORDS]
            bucket, owner = word_grams(part)
            out[at:at + WORDS] = np.bincount(owner, self.grams[bucket], len(part)) / np.bincount(owner, minlength=len(part))
        return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def windows_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, last word, first window of each text) of all windows of texts of so many words, none of them empty.

    Windows begin at every word but the last one; a text of one word is a window of its own.
    """
    count = np.maximum(lengths - 1, 1)
    first_window = np.cumsum(count) - count
    left = np.arange(count.sum()) - np.repeat(first_window, count) + np.repeat(np.cumsum(lengths) - lengths, count)
    return left, left + np.repeat(lengths > 1, count), first_window


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Embeddings and softmax weights, trained jointly by full-batch Adam; the same rows in the same order give the same model.

    Embeddings are averaged over a word's n-grams and a window's words. A document counts by its most toxic window, so
    a short insult in a long text is not averaged away; in training its windows are weighed softly at first and more and
    more sharply. With labels of one class or none the model scores every text by that share. N-grams are held as 32-bit
    numbers and worked on in parts, so the driver needs about six bytes per n-gram of a distinct word.
    """
    y = np.asarray(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), 40.0 if len(y) and y[0] else -40.0)
    index: dict[str, int] = {}
    tokens = [np.fromiter((index.setdefault(w, len(index)) for w in words_of(t)), np.int32) for t in texts]
    lengths = np.array([len(t) for t in tokens])
    if not lengths.any():
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(y.mean() / (1 - y.mean()))))
    y, lengths, flat = y[lengths > 0], lengths[lengths > 0], np.concatenate(tokens)
    if y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), 40.0 if y[0] else -40.0)
    words, n_words = list(index), len(index)
    del tokens, index
    parts = []  # (buckets, words of the part, n-grams of each)
    for at in range(0, n_words, WORDS):
        bucket, owner = word_grams(words[at:at + WORDS])
        parts.append((bucket.astype(np.int32), slice(at, min(at + WORDS, n_words)), np.bincount(owner)))
    del words
    left, right, first_window = windows_of(lengths)
    left, right = flat[left], flat[right]
    window_doc = np.repeat(np.arange(len(lengths), dtype=np.int32), np.diff(np.append(first_window, len(left))))
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())

    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 1.0, DIM), np.array([-1.0])]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    value = np.zeros(n_words)
    for step in range(1, PASSES + 1):
        table, out, bias = params
        gram = table @ out
        for bucket, mine, count in parts:
            value[mine] = np.add.reduceat(gram[bucket], np.cumsum(count) - count) / count
        window = (value[left] + value[right]) / 2
        sharp = SHARP[0] * (SHARP[1] / SHARP[0]) ** (step / PASSES)
        share = np.exp(sharp * (window - np.maximum.reduceat(window, first_window)[window_doc]))
        share /= np.add.reduceat(share, first_window)[window_doc]
        error = (_sigmoid(np.add.reduceat(share * window, first_window) + bias[0]) - y) * weight
        share *= error[window_doc] / 2
        per_word = np.bincount(left, share, n_words) + np.bincount(right, share, n_words)
        per_gram = np.zeros(BUCKETS)
        for bucket, mine, count in parts:
            per_gram += np.bincount(bucket, np.repeat(per_word[mine] / count, count), BUCKETS)
        grads = [np.outer(per_gram, out), per_gram @ table, np.array([error.sum()])]
        for p, g, (m, v) in zip(params, grads, moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        params[0] *= 1 - RATE * DECAY
    table, out, bias = params
    return Model((table @ out).astype(np.float32), float(bias[0]))


def sample(docs: DataFrame, labels: DataFrame, use: Column, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, text, label) of at most ``SAMPLE_ROWS`` labelled documents of a class, the smallest id hashes first.

    Labels of one id that agree count once. An id labelled both ways is learned from as both, and of rows that repeat an
    id one text is taken, the smallest, so the bound holds for rows too.
    """
    known = labels.where(use & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_x_id"), F.col(label_col).alias("_x_label")).distinct()
    order = [F.xxhash64("_x_id"), F.col("_x_id")]
    picked = [known.where(F.col("_x_label") == c).orderBy(*order).limit(SAMPLE_ROWS[c]) for c in (0, 1)]
    # At most sum(SAMPLE_ROWS) ids, whatever the size of the tables.
    chosen = F.broadcast(picked[0].unionAll(picked[1]))
    texts = docs.where(F.char_length(text_col) <= SAMPLE_CHARS).select(F.col(id_col).alias("_x_id"), F.col(text_col).alias("_x_text"))
    return texts.join(chosen, "_x_id").groupBy("_x_id", "_x_label").agg(F.min("_x_text").alias("_x_text"))


def fit(
    docs: DataFrame, labels: DataFrame, use: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Model:
    """A model from the labelled rows for which ``use`` holds, by a bounded sample of them (see :func:`sample`)."""
    rows = sample(docs, labels, F.lit(True) if use is None else use, id_col, text_col, label_col).select("_x_id", "_x_text", "_x_label").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["_x_id"], r["_x_label"]))
    return train([r["_x_text"] for r in rows], [int(r["_x_label"]) for r in rows])


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` plus the probability that its most toxic window is toxic; one row per row, no shuffle.

    Whole texts are read. Null, empty and blank texts have no window and get the probability of the bias alone. Other
    columns are kept; an input column ``out_col`` is replaced.
    """
    kept = [c for c in docs.columns if c != out_col]
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            sizes = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch[text_col]])
            at = 0
            while at < batch.num_rows:
                to = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BYTES, "right"))
                part = batch.slice(at, max(1, min(to - at, ROWS)))
                at += part.num_rows
                tokens = [words_of(x.as_py() or "") for x in part[text_col]]
                if len(known) > MEMO:
                    known.clear()
                new = list({w for t in tokens for w in t if w not in known})
                known.update(zip(new, model.word_values(new).tolist()))
                lengths = np.array([len(t) for t in tokens])
                tops = np.zeros(len(tokens))
                if lengths.any():
                    value = np.fromiter((known[w] for t in tokens for w in t), np.float64, int(lengths.sum()))
                    left, right, first_window = windows_of(lengths[lengths > 0])
                    tops[lengths > 0] = np.maximum.reduceat((value[left] + value[right]) / 2, first_window)
                scores = pa.array(_sigmoid(tops + model.bias), pa.float64())
                yield pa.RecordBatch.from_arrays([*[part[c] for c in kept], scores], [*kept, out_col])

    return docs.select(*kept).mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in kept], f"`{out_col}` double"]))
