"""Languages of texts: scripts narrow the candidates, a Viterbi search with a price for switching labels spans."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Documents per language that a model learns from at most, the smallest hashes of their ids first; their whole texts count.
SAMPLE = 2_000
# Lengths of character n-grams, and rows of the table that they are hashed to.
ORDERS, BUCKETS, SMOOTH = (1, 2, 3, 4), 1 << 16, 0.5
# The price of a switch, and how much one word can speak against a candidate, in nats a letter's worth; what is narrowed out.
SWITCH, CLIP, OUT = 12.0, 10.0, 1_000.0
# A script belongs to a language from this share of its letters.
SHARE = 0.01
# Texts and code points looked at together, words whose n-grams are held at once, and code points of words remembered.
ROWS, CHARS, WORDS, MEMO = 256, 1 << 22, 4_000, 1 << 22
UNKNOWN = "und"
# First and last code points of scripts' letters, and scripts that write no spaces between words.
SCRIPTS = [
    (0x0041, 0x024F, "Latin"), (0x0250, 0x02AF, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x06FF, "Arabic"), (0x0700, 0x074F, "Syriac"), (0x0750, 0x077F, "Arabic"), (0x0780, 0x07BF, "Thaana"),
    (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"), (0x0A00, 0x0A7F, "Gurmukhi"), (0x0A80, 0x0AFF, "Gujarati"), (0x0B00, 0x0B7F, "Oriya"),
    (0x0B80, 0x0BFF, "Tamil"), (0x0C00, 0x0C7F, "Telugu"), (0x0C80, 0x0CFF, "Kannada"), (0x0D00, 0x0D7F, "Malayalam"), (0x0D80, 0x0DFF, "Sinhala"),
    (0x0E00, 0x0E7F, "Thai"), (0x0E80, 0x0EFF, "Lao"), (0x0F00, 0x0FFF, "Tibetan"), (0x1000, 0x109F, "Myanmar"), (0x10A0, 0x10FF, "Georgian"),
    (0x1100, 0x11FF, "Hangul"), (0x1200, 0x139F, "Ethiopic"), (0x1780, 0x17FF, "Khmer"), (0x1800, 0x18AF, "Mongolian"), (0x1E00, 0x1EFF, "Latin"),
    (0x1F00, 0x1FFF, "Greek"), (0x2C60, 0x2C7F, "Latin"), (0x3040, 0x309F, "Hiragana"), (0x30A0, 0x30FF, "Katakana"), (0x3130, 0x318F, "Hangul"),
    (0x3400, 0x4DBF, "Han"), (0x4E00, 0x9FFF, "Han"), (0xA720, 0xA7FF, "Latin"), (0xAC00, 0xD7AF, "Hangul"), (0xF900, 0xFAFF, "Han"),
    (0xFB50, 0xFDFF, "Arabic"), (0xFE70, 0xFEFF, "Arabic"), (0xFF21, 0xFF5A, "Latin"), (0xFF66, 0xFF9F, "Katakana"), (0x20000, 0x3FFFF, "Han"),
]
UNSPACED = {"Thai", "Lao", "Tibetan", "Myanmar", "Khmer", "Hiragana", "Katakana", "Han"}
OTHER = "Other"
NAMES = sorted({name for _, _, name in SCRIPTS} | {OTHER})
_STARTS = [start for start, _, _ in SCRIPTS]
_MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def script_of(char: str) -> str:
    at = bisect_right(_STARTS, ord(char)) - 1
    return SCRIPTS[at][2] if at >= 0 and ord(char) <= SCRIPTS[at][1] else OTHER


def words_of(text: str) -> Iterator[tuple[int, str, str]]:
    """(start, word, script): runs of letters and their marks, cut where the script changes; unspaced scripts by letters."""
    for found in _WORD.finditer(text):
        run, at = found.group(), found.start()
        if run.isascii():
            yield at, run, "Latin"
            continue
        begin, script = 0, script_of(run[0])
        for i, char in enumerate(run):
            if i and char.isalpha():
                now = script_of(char)
                if now != script or now in UNSPACED:
                    yield at + begin, run[begin:i], script
                    begin, script = i, now
        yield at + begin, run[begin:], script


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, word index) of the character n-grams of ``<word>``, in word order."""
    marked = [f"<{w.lower()}>" for w in words]
    length = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), length)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(codes))  # code points from here to the end of the word
    buckets, owners, rolling = [], [], np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for n in ORDERS:
            shifted = np.zeros(len(codes), np.uint64)
            shifted[:max(0, len(codes) - n + 1)] = codes[n - 1:]
            rolling = (rolling + shifted + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            rolling ^= rolling >> np.uint64(32)
            fits = left >= n
            buckets.append((rolling[fits] % np.uint64(BUCKETS)).astype(np.int64))
            owners.append(owner[fits])
    bucket, owner = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return bucket[order], owner[order]


@dataclass
class Model:
    """Learned languages, the log share of every n-gram bucket in each, and which scripts each is written in."""

    langs: list[str]
    table: np.ndarray  # BUCKETS x languages
    scripts: np.ndarray  # script x languages, boolean

    def word_scores(self, words: list[str], scripts: list[str]) -> np.ndarray:
        """(word, language): log likelihoods below the best candidate's. A letter is in one n-gram of every length, so their sum is divided by the lengths."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        for at in range(0, len(words), WORDS):
            bucket, owner = grams(words[at:at + WORDS])
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            out[at:at + WORDS] = np.add.reduceat(self.table[bucket], first) / len(ORDERS)
        allowed = self.scripts[[NAMES.index(s) for s in scripts]]
        allowed = allowed | ~allowed.any(axis=1, keepdims=True)  # a script that no language is written in narrows nothing
        out[~allowed] = -np.inf
        return np.where(allowed, np.maximum(out - out.max(axis=1, keepdims=True), -CLIP), -OUT).astype(np.float32)


def _counts(lang: str, text: str):
    """(language, bucket or -1 - script, count) of a task's texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        letters: dict[str, Counter] = {}
        for batch in batches:
            for name, value in zip(batch[lang].to_pylist(), batch[text]):
                seen = Counter((w, s) for _, w, s in words_of(value.as_py() or ""))
                if not seen:
                    continue
                total = held.setdefault(name, np.zeros(BUCKETS, np.int64))
                words, times = [w for w, _ in seen], np.array(list(seen.values()))
                for at in range(0, len(words), WORDS):
                    bucket, owner = grams(words[at:at + WORDS])
                    total += np.bincount(bucket, times[at:at + WORDS][owner], BUCKETS).astype(np.int64)
                for (w, s), n in seen.items():
                    letters.setdefault(name, Counter())[s] += len(w) * n
        for name, total in held.items():
            at = np.flatnonzero(total)
            more = [(-1 - NAMES.index(s), n) for s, n in letters[name].items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(at) + len(more)), pa.string()), pa.array([*at.tolist(), *[k for k, _ in more]], pa.int64()),
                 pa.array([*total[at].tolist(), *[n for _, n in more]], pa.int64())], ["lang", "bucket", "n"])
    return run


def fit(docs: DataFrame, use: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from the rows of ``docs`` for which ``use`` holds and ``lang_col`` is not null, at most ``SAMPLE`` ids per language.

    N-grams are counted in tasks; the driver gets one number per language and bucket. Null and empty texts add nothing,
    a repeated row counts as often as it is there, and without any letter to learn from no language is known.
    """
    known = docs.where((F.lit(True) if use is None else use) & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).alias("text"))
    order = Window.partitionBy("lang").orderBy("h")
    # One row per language: the highest hash of its sample. The driver holds a whole table per language in any case.
    last = known.select("lang", "h").withColumn("r", F.row_number().over(order)).where(F.col("r") <= SAMPLE).groupBy("lang").agg(F.max("h").alias("last"))
    sample = known.join(F.broadcast(last), "lang").where(F.col("h") <= F.col("last")).select("lang", "text")
    counted = sample.mapInArrow(_counts("lang", "text"), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    langs = sorted(set(counted["lang"]))
    table, scripts = np.zeros((BUCKETS, len(langs))), np.zeros((len(NAMES), len(langs)))
    for i, lang in enumerate(langs):
        mine = counted[counted["lang"] == lang]
        buckets, n = mine["bucket"].to_numpy(), mine["n"].to_numpy()
        table[buckets[buckets >= 0], i] = n[buckets >= 0]
        scripts[-1 - buckets[buckets < 0], i] = n[buckets < 0]
    if langs:
        # Brought to one total, so an n-gram that no language has speaks for none.
        table *= table.sum() / len(langs) / table.sum(axis=0)
        table = np.log(table + SMOOTH)
        table -= table.mean(axis=1, keepdims=True)
        scripts = scripts >= SHARE * scripts.sum(axis=0)
    return Model(langs, table.astype(np.float32), scripts.astype(bool))


def best_path(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Labels of many stretches of words at once: the Viterbi search over ``scores`` (word, language), one step per place.

    ``before`` and ``after`` are the labels next to a stretch, -1 where the text begins or ends.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, lengths, before, after = starts[order], lengths[order], before[order], after[order]
    n_langs = scores.shape[1]
    total = np.where(before[:, None] < 0, 0.0, np.where(np.arange(n_langs) == before[:, None], 0.0, -SWITCH))
    offset = np.cumsum(lengths) - lengths
    back = np.zeros((int(lengths.sum()), n_langs), np.int32)
    open_at = [int(np.searchsorted(-lengths, -t, "left")) for t in range(int(lengths[0]))]  # stretches longer than t
    for t, n in enumerate(open_at):
        now = total[:n]
        if t:
            top = now.argmax(axis=1)
            switched = now[np.arange(n), top][:, None] - SWITCH
            back[offset[:n] + t] = np.where(switched > now, top[:, None], np.arange(n_langs))
            now = np.maximum(now, switched)
        total[:n] = now + scores[starts[:n] + t]
    total -= np.where((after[:, None] < 0) | (np.arange(n_langs) == after[:, None]), 0.0, SWITCH)
    state = total.argmax(axis=1)
    labels = np.zeros(len(back), np.int64)
    for t in range(len(open_at) - 1, -1, -1):
        n = open_at[t]
        at = offset[:n] + t
        labels[at] = state[:n]
        state[:n] = back[at, state[:n]]
    out = np.full(len(scores), -1)
    out[np.repeat(starts - offset, lengths) + np.arange(len(labels))] = labels
    return out


def label_words(scores: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The language of every word: per text (words up to each of ``ends``) the labels of highest total score less switches.

    A text's main language ``a`` has the highest total. A stretch in other languages gains at most the sum of each word's
    best difference to ``a``; one that begins or ends with a negative sum gains from being shorter. So outside of the
    excursions of that running sum above its lowest value every word is ``a``, and an excursion that never gains as much
    as its switches cost is ``a`` too. Only the others are searched.
    """
    labels = np.zeros(len(scores), np.int64)
    starts, lengths, before, after, begin = [], [], [], [], 0
    for end in ends.tolist():
        if end == begin:
            continue
        mine = scores[begin:end]
        main = int(mine.sum(axis=0, dtype=np.float64).argmax())
        labels[begin:end] = main
        if mine.shape[1] > 1:
            others = np.delete(mine, main, axis=1).max(axis=1)
            run = np.cumsum((others - mine[:, main]).astype(np.float64))
            if run.max() - min(0.0, run.min()) > SWITCH:  # no stretch can gain more than this
                lowest = np.minimum(np.minimum.accumulate(run), -SWITCH)
                above = run - lowest
                inside = above > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
                for a, b in edges.reshape(-1, 2).tolist():
                    at_end = b == end - begin
                    if above[a:b].max() > (SWITCH if at_end else 2 * SWITCH):
                        starts.append(begin + a)
                        lengths.append(b - a)
                        before.append(main if a else -1)
                        after.append(-1 if at_end else main)
        begin = end
    if starts:
        found = best_path(scores, *(np.array(x) for x in (starts, lengths, before, after)))
        labels = np.where(found >= 0, found, labels)
    return labels


class Words:
    """Numbers of the words of tokens, and their scores; forgotten together when they are many."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}  # token to word number, -1 for none, -2 - i for the i-th list of several
        self.several: list[np.ndarray] = []
        self.number: dict[tuple[str, str], int] = {}
        self.scores, self.letters, self.chars = np.zeros((0, len(self.model.langs)), np.float32), np.zeros(0, np.int64), 0

    def learn(self, tokens: set[str]) -> None:
        if self.chars > MEMO:
            self.clear()
        fresh: list[tuple[str, str]] = []
        for token in tokens:
            if token not in self.known:
                self.chars += len(token) + 20
                mine, bare = [], token.strip(_MARKS)
                # Most tokens are one Latin word and marks.
                for key in [(bare, "Latin")] if bare.isalpha() and (bare.isascii() or max(bare) < "\u0250") else [(w, s) for _, w, s in words_of(token)]:
                    if key not in self.number:
                        self.number[key] = len(self.number)
                        fresh.append(key)
                    mine.append(self.number[key])
                if len(mine) > 1:
                    self.several.append(np.array(mine))
                self.known[token] = mine[0] if len(mine) == 1 else -1 - len(self.several) if mine else -1
        if fresh:
            self.scores = np.concatenate([self.scores, self.model.word_scores([w for w, _ in fresh], [s for _, s in fresh])])
            self.letters = np.concatenate([self.letters, np.array([len(w) for w, _ in fresh])])

    def numbers(self, tokens: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        if len(at) and at.min() < -1:
            at = np.concatenate([self.several[-2 - x] if x < -1 else [x] for x in at.tolist()]).astype(np.int64)
        return at[at >= 0]


def _spans(text: str, labels: np.ndarray, langs: list[str]) -> list[dict]:
    """Stretches of one label, which cover the text; each but the first begins with its first word."""
    change = np.flatnonzero(np.diff(labels)) + 1
    if not len(change):
        return [{"start": 0, "end": len(text), "lang": langs[labels[0]]}]
    begins = [start for start, _, _ in words_of(text)]
    starts = [0, *[begins[i] for i in change]]
    return [{"start": a, "end": b, "lang": langs[labels[i]]} for a, b, i in zip(starts, [*starts[1:], len(text)], [0, *change])]


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``lang_pred``, ``score`` and ``spans`` (start, end in code points, language); one row per row, no shuffle.

    The language with the most letters in spans is predicted, the first in order at equality. ``score`` is its share of
    the letters times its softmax share over the words of its spans. Null texts and texts without a letter are ``und``
    with score 0 and no spans, as are all texts if the model knows no language. Whole texts are read, however long. Other
    columns are kept, but input columns of the three names are replaced.
    """
    new = ("lang_pred", "score", "spans")
    kept = [c for c in docs.columns if c not in new]
    kinds = dict(docs.dtypes)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
    langs = model.langs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model)
        for batch in batches:
            sizes = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch[text_col]])
            at = 0
            while at < batch.num_rows:
                done = sizes[at - 1] if at else 0
                to = max(at + 1, min(at + ROWS, int(np.searchsorted(sizes, done + CHARS, "right"))))
                part = batch.slice(at, to - at)
                at = to
                texts = [x or "" for x in part[text_col].to_pylist()] if langs else [""] * part.num_rows
                tokens = [t.split() for t in texts]
                words.learn({t for some in tokens for t in some})
                number = [words.numbers(t) for t in tokens]
                ends = np.cumsum([len(x) for x in number])
                flat = np.concatenate(number) if number else np.zeros(0, np.int64)
                scores, letters = words.scores[flat], words.letters[flat]
                labels = label_words(scores, ends)
                out, begin = [], 0
                for text, end in zip(texts, ends.tolist()):
                    if end == begin:
                        out.append((UNKNOWN, 0.0, []))
                        continue
                    mine, size = labels[begin:end], letters[begin:end]
                    held = np.bincount(mine, size, len(langs))
                    top = int(held.argmax())
                    total = scores[begin:end][mine == top].sum(axis=0, dtype=np.float64)
                    share = 1 / np.exp(np.minimum(total - total[top], 700)).sum()
                    out.append((langs[top], min(1.0, float(held[top] / held.sum() * share)), _spans(text, mine, langs)))
                    begin = end
                yield pa.RecordBatch.from_arrays(
                    [*[part[c] for c in kept], *[pa.array(x, k) for x, k in zip(zip(*out), (pa.string(), pa.float64(), span))]], [*kept, *new])

    schema = [*[f"`{c}` {kinds[c]}" for c in kept], "lang_pred string", "score double", "spans array<struct<start: long, end: long, lang: string>>"]
    return docs.select(*kept).mapInArrow(run, ", ".join(schema))
