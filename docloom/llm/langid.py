"""Language of every word by a linear-chain conditional random field, and of the text from its words.

A word's features are its prefixes and suffixes, its character trigrams and, if it is one of the frequent words of the sample,
itself (the lexicon), hashed into one weight table. Transitions between the labels of neighbouring words are learned with
them, on sequences that switch language where texts of different languages are joined. Forward-backward over the whole
text gives each word its label probabilities; their mean names the text's language and its score.

Training is on the driver, on at most ``per_language`` texts of each language (the smallest by a hash of the id), ``window``
words of each. Prediction is a map over Arrow batches, in slices of bounded words; all texts of a slice are walked
together. A run of more than 40 letters counts as consecutive words of 40, so unspaced text is read whole. No shuffle carries text.

A null text, or one without a letter, is ``und`` with score 0, and so is every text if nothing could be learned. Languages
that are null are not learned from. Repeated rows and null ids are each predicted. Other columns are not looked at, and
neither ids nor languages enter a prediction.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.base import table
from docloom.llm.registry import register

RUN = re.compile(r"[^\W\d_]{1,40}")  # a longer run of letters is read as consecutive words
BUCKETS = 1 << 15
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    return RUN.findall(text.lower())


def has_letter(text: str, words: list[str]) -> bool:
    return any(w.isalpha() for w in words) or any(c.isalpha() for c in text)


class Crf:
    """Weights of hashed word features and of label transitions."""

    def __init__(self, labels: list[str], lexicon: frozenset[str]):
        self.labels, self.lexicon = labels, lexicon
        self.weights = np.zeros((BUCKETS, len(labels)), np.float32)
        self.moves = np.zeros((len(labels), len(labels)), np.float32)
        self.known: dict[str, int] = {}  # words met by this process and their row in ``scores``
        self.scores = np.zeros((0, len(labels)), np.float32)

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "scores": self.scores[:0]}

    def features(self, word: str) -> list[int]:
        w = f"^{word}$"
        n = len(w)
        names = [w[:2], w[:3], w[:4], w[-2:] + "<", w[-3:] + "<", w[-4:] + "<", *[w[i : i + 3] + "=" for i in range(n - 2)]]
        if word in self.lexicon:
            names.append(word + "#")
        return [zlib.crc32(x.encode()) & (BUCKETS - 1) for x in names]

    # -- inference

    def rows(self, words: list[str], most: int = 400_000) -> np.ndarray:
        """The row of each word in ``scores``; new words are scored, and the table starts anew when it is full."""
        if len(self.known) > most:
            self.known, self.scores = {}, self.scores[:0]
        known, start = self.known, len(self.known)
        out = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        fresh = list(known)[start:] if len(known) > start else []
        if fresh:
            feats = [self.features(w) for w in fresh]
            flat = np.fromiter((i for f in feats for i in f), np.int64)
            starts = np.concatenate([[0], np.cumsum([len(f) for f in feats])[:-1]])
            self.scores = np.concatenate([self.scores, np.add.reduceat(self.weights[flat], starts, axis=0)])
        return out

    def posteriors(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Label probabilities of every word of every text (none of them empty)."""
        lengths = np.array([len(t) for t in texts])
        order = np.argsort(-lengths, kind="stable")
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        at = self.rows([w for t in texts for w in t])
        e = self.scores[at]
        e = np.exp(e - e.max(axis=1, keepdims=True))
        step = np.exp(self.moves - self.moves.max())
        first, n = starts[order], lengths[order]
        active = np.searchsorted(-n, -np.arange(n[0]), side="left")  # texts longer than t
        alpha = np.empty_like(e)
        now = e[first]
        now /= now.sum(axis=1, keepdims=True)
        alpha[first] = now
        for t in range(1, n[0]):
            k = active[t]
            at = first[:k] + t
            now = (now[:k] @ step) * e[at]
            now /= now.sum(axis=1, keepdims=True)
            alpha[at] = now
        beta = np.ones((len(texts), len(self.labels)), np.float32)
        for t in range(n[0] - 2, -1, -1):
            k = active[t + 1]
            at = first[:k] + t
            back = (e[at + 1] * beta[:k]) @ step.T
            beta[:k] = back / back.sum(axis=1, keepdims=True)
            alpha[at] *= beta[:k]
        alpha /= alpha.sum(axis=1, keepdims=True)
        return np.split(alpha, starts[1:])

    # -- training

    def fit(self, sequences: list[tuple[list[str], list[int]]], epochs: int, rate: float, seed: int, batch: int = 64) -> Crf:
        """Adagrad on the conditional likelihood; all sequences have one length."""
        r = np.random.default_rng(seed)
        n_labels, length = len(self.labels), len(sequences[0][0])
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for s, _ in sequences for w in s))}
        feats = [self.features(w) for w in vocabulary]
        width = max(map(len, feats))
        # padding points to a bucket of its own, whose weight is never used
        padded = np.array([f + [BUCKETS] * (width - len(f)) for f in feats])
        weights = np.zeros((BUCKETS + 1, n_labels))
        moves = np.zeros((n_labels, n_labels))
        gw, gm = np.full_like(weights, 1e-2), np.full_like(moves, 1e-2)
        x = np.array([[vocabulary[w] for w in s] for s, _ in sequences])
        y = np.array([labels for _, labels in sequences])
        eye = np.eye(n_labels)
        for _ in range(epochs):
            for rows in np.array_split(r.permutation(len(x)), max(1, len(x) // batch)):
                idx = padded[x[rows]]  # batch, time, features
                weights[BUCKETS] = 0
                e = weights[idx].sum(axis=2)
                e = np.exp(e - e.max(axis=2, keepdims=True))
                step = np.exp(moves)
                alpha, beta = np.empty_like(e), np.ones_like(e)
                alpha[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
                for t in range(1, length):
                    a = (alpha[:, t - 1] @ step) * e[:, t]
                    alpha[:, t] = a / a.sum(axis=1, keepdims=True)
                for t in range(length - 2, -1, -1):
                    b = (e[:, t + 1] * beta[:, t + 1]) @ step.T
                    beta[:, t] = b / b.sum(axis=1, keepdims=True)
                gamma = alpha * beta
                gamma /= gamma.sum(axis=2, keepdims=True)
                pair = alpha[:, :-1, :, None] * step * (e * beta)[:, 1:, None, :]
                pair /= pair.sum(axis=(2, 3), keepdims=True)
                truth = eye[y[rows]]
                grad = np.zeros_like(weights)
                np.add.at(grad, idx.ravel(), np.repeat((truth - gamma).reshape(-1, n_labels), width, axis=0))
                grad /= len(rows)
                seen = truth[:, :-1, :, None] * truth[:, 1:, None, :]
                move_grad = (seen - pair).sum(axis=(0, 1)) / len(rows)
                gw += grad**2
                gm += move_grad**2
                weights += rate * grad / np.sqrt(gw)
                moves += rate * move_grad / np.sqrt(gm)
        self.weights, self.moves = weights[:BUCKETS].astype(np.float32), moves.astype(np.float32)
        return self


def train(samples: list[tuple[str, list[str]]], lexicon_size: int = 300, sequences: int = 3000, length: int = 32, switch: float = 0.08, epochs: int = 6, rate: float = 0.3, seed: int = 11) -> Crf | None:
    """Fit on (language, words) samples, joined into sequences that switch text with chance ``switch`` per word."""
    samples = sorted((lang, words) for lang, words in samples if words)
    if not samples:
        return None
    labels = sorted({lang for lang, _ in samples})
    counts = {lang: Counter() for lang in labels}
    for lang, words in samples:
        counts[lang].update(set(words))
    lexicon = frozenset(w for c in counts.values() for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:lexicon_size])
    by_label = {lang: [w for x, w in samples if x == lang] for lang in labels}
    r = np.random.default_rng(seed)
    data = []
    for _ in range(sequences):
        words, marks = [], []
        while len(words) < length:
            k = int(r.integers(len(labels)))
            own = by_label[labels[k]]
            text = own[int(r.integers(len(own)))]
            take = min(length - len(words), int(r.geometric(switch)), len(text))
            at = int(r.integers(len(text) - take + 1))
            words += text[at : at + take]
            marks += [k] * take
        data.append((words, marks))
    return Crf(labels, lexicon).fit(data, epochs, rate, seed)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame, per_language: int = 600, window: int = 80, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Crf | None:
    """Learn from the rows outside the held-out fold that have a language and a text."""
    known = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    known = known.withColumn("h", F.xxhash64("id"))
    sizes = known.groupBy("lang").count().collect()  # a row per language
    if not sizes:
        return None
    # a hash cut leaves about twice what is wanted of a language, so that few texts are sorted
    part = F.pmod(F.col("h"), F.lit(1_000_000)) / 1e6
    chance = F.element_at(F.create_map(*[F.lit(v) for r in sizes for v in (r.lang, min(1.0, 2 * per_language / r["count"] + 50 / r["count"]))]), F.col("lang"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))
    chosen = known.where(part <= chance).withColumn("rank", rank).where(F.col("rank") <= per_language)
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    at = F.pmod("h", F.greatest(F.size("w") - window, F.lit(1))).cast("int") + 1
    rows = chosen.select("lang", "h", tokens.alias("w")).select("lang", F.slice("w", at, window).alias("w")).collect()
    return train([(r.lang, [w for w in r.w if w]) for r in rows])


def _tag(model: Crf | None, runs: bool, most: int = 1_000_000):
    def verdicts(texts: list[str | None]):
        """(label, score, runs) of each; walked in slices of bounded words."""
        out = [(UNKNOWN, 0.0, [])] * len(texts)
        todo, size = [], 0
        for i, t in enumerate(texts):
            words = words_of(t) if t and model else []
            if words and has_letter(t, words):
                todo.append((i, words))
                size += len(words)
            if todo and (size > most or i == len(texts) - 1):
                for (j, own), p in zip(todo, model.posteriors([w for _, w in todo])):
                    mean = p.mean(axis=0, dtype=np.float64)
                    best = int(mean.argmax())
                    spans = []
                    if runs:
                        marks = p.argmax(axis=1)
                        cuts = np.flatnonzero(np.diff(marks)) + 1
                        spans = [
                            {"start": int(a), "end": int(b), "lang": model.labels[marks[a]]}
                            for a, b in zip([0, *cuts], [*cuts, len(own)])
                        ]
                    out[j] = (model.labels[best], min(1.0, float(mean[best])), spans)
                todo, size = [], 0
        return out

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        for batch in batches:
            found = verdicts(batch.column(0).to_pylist())
            cols = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            cols += [pa.array([f[2] for f in found], kind)] if runs else []
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], [*batch.schema.names[1:], "lang_pred", "score", *["runs"] * runs])

    return run


def languages(docs: DataFrame, model: Crf | None, runs: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score and, if asked for, the ``runs`` of words (start, end, lang) of every row."""
    source = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"))
    kind = source.schema["doc_id"].dataType.simpleString()
    more = ", runs array<struct<start:int,end:int,lang:string>>" if runs else ""
    return source.mapInArrow(_tag(model, runs), f"doc_id {kind}, held_out boolean, lang_pred string, score double{more}")


@register("op5_langid")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return languages(docs, fitted(docs))
