"""Quality of documents from a linear-chain conditional random field over their lines.

A line is described by shares and counts of its characters and words, by whether it repeats an earlier line, and by the same of the
line before and the line after it. The field has two labels, good and bad, weights for these features and for the transitions
between neighbouring lines. Forward-backward gives every line the probability of being good; their mean, weighted by the lines' lengths, goes
through a logistic calibration (``Model.calibrate``), which never turns the order around, to the document's score.

Only documents are labelled, so lines start with the label of their document. Then the field is fitted, the lines of bad documents
take the label it finds likelier (the worst line of a document stays bad), and it is fitted again, ``rounds`` times in all.

Training is on the driver, on windows of at most ``window`` lines (of many lines, those from a place that the hash of the id names) of at
most ``per_class`` documents of each label, those with the smallest hashes; tasks turn them to bits before they are sent. Documents
with several differing labels are not learned from. Scoring is a map over Arrow batches in slices of bounded size; no shuffle carries a text. A line of more
than ``PIECE`` code points counts as consecutive lines of that length, so nothing is left out and no text is too long.

A null or empty text is one empty line and gets the score of that. Without labelled documents of both kinds every score is the share of good
ones (0.5 without any). Repeated rows and null ids are each scored. Ids, sources, languages and labels enter no score. Extra columns are not looked at.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.base import space_words, table
from docloom.llm.registry import register

PIECE = 1 << 20  # code points that are looked at together, and the longest line
ODD = np.uint64(0x9E3779B97F4A7C15)

# -- features of lines --------------------------------------------------------------------------

#: what a line is measured by, and the cuts at which a measure becomes bits
CUTS = {
    "chars": (0, 20, 60, 150, 400, 1500),
    "words": (0, 1, 3, 8, 20, 60),
    "word_length": (2.5, 3.5, 5, 7, 10, 20),
    "upper": (0.02, 0.15, 0.4, 0.8),
    "digits": (0.02, 0.1, 0.3),
    "marks": (0.03, 0.08, 0.15, 0.3),
    "symbols": (0, 0.02, 0.05, 0.12, 0.25),
    "bars": (0, 0.02, 0.06, 0.15),
    "shouts": (0, 0.02, 0.06),
    "beyond_ascii": (0.02, 0.2, 0.6),
    "repeats": (0, 0.05, 0.2, 0.35, 0.5, 0.9),
    "common_words": (0.02, 0.1, 0.2, 0.35, 0.5),
    "ends": (0.5,),
    "copy": (0.5,),
}
WIDTH = sum(map(len, CUTS.values())) + 1
_CUT = np.concatenate([np.array(c, np.float32) for c in CUTS.values()])
_OF = np.repeat(np.arange(len(CUTS)), [len(c) for c in CUTS.values()])

SPACE_CLASS, UPPER_CLASS, LOWER_CLASS, DIGIT_CLASS, SYMBOL_CLASS, BAR_CLASS, SHOUT_CLASS, MARK_CLASS, OTHER_CLASS = range(9)


def _classes() -> np.ndarray:
    """Class of every code point below 0x3000; what lies above counts as the last one."""
    out = np.full(0x3001, OTHER_CLASS, np.uint8)
    for c in range(0x3000):
        s = chr(c)
        if c < 128:
            kind = MARK_CLASS
            kind = SPACE_CLASS if s in " \t\n\x0b\x0c\r" else kind
            kind = DIGIT_CLASS if s.isdigit() else kind
            kind = SYMBOL_CLASS if s in "#*$%&<>=_~^{}[]\\@`+" else kind
            kind = BAR_CLASS if s == "|" else SHOUT_CLASS if s in "!?" else kind
            kind = UPPER_CLASS if s.isupper() else LOWER_CLASS if s.islower() else kind
            out[c] = kind
        elif s.isupper():
            out[c] = UPPER_CLASS
    return out


CLASSES = _classes()


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD**i and its inverse, for i up to ``n``; dividing is multiplying by the inverse, as ODD is odd."""
    one = np.ones(1, np.uint64)
    inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
    return tuple(np.cumprod(np.concatenate([one, np.full(n, x)]), dtype=np.uint64) for x in (ODD, inverse))


def hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each stretch, the same wherever it stands."""
    power, back = _powers(1 << max(10, (len(values) + 1).bit_length()))
    terms = (values.astype(np.uint64) + np.uint64(1)) * power[: len(values)]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    return (total[ends] - total[starts]) * back[starts]


def word_hash(word: str) -> int:
    values = np.frombuffer(word.encode("utf-32-le", "replace"), np.uint32)
    return int(hashes(values, np.array([0]), np.array([len(values)]))[0])


def measures(text: str, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every \\n-split line: its measures but for ``copy``, its length, and a hash of it (0 if it has no word)."""
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kind = CLASSES[np.minimum(cp, 0x3000)]
    breaks = np.flatnonzero(cp == 10)
    starts, ends = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(cp)]])
    n = len(starts)

    def each(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[ends] - total[starts]).astype(np.float32)

    full = kind != SPACE_CLASS
    edge = np.diff(np.concatenate([[0], full.astype(np.int8), [0]]))
    w_start, w_end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    w_line = np.searchsorted(breaks, w_start)
    low = np.where((cp >= 65) & (cp <= 90), cp + 32, cp)
    low_kind = (kind == UPPER_CLASS) | (kind == LOWER_CLASS) | (kind == OTHER_CLASS) | (kind == DIGIT_CLASS)
    h = hashes(low, w_start, w_end)
    same = np.zeros(len(h), bool)
    for back in (1, 2):  # the same word again, or two words by turns
        same[back:] |= (h[back:] == h[:-back]) & (w_line[back:] == w_line[:-back])
    # for the lexicon, marks at the end of a word do not count
    last = w_end.copy()
    for _ in range(3):
        last = np.where((last > w_start) & ~low_kind[np.maximum(last - 1, 0)], last - 1, last)
    known = np.isin(hashes(low, w_start, np.maximum(last, w_start)), common)
    words = np.bincount(w_line, minlength=n).astype(np.float32)
    solid = each(full)
    letters = each((kind == UPPER_CLASS) | (kind == LOWER_CLASS) | (kind == OTHER_CLASS))
    one, some = np.maximum(words, 1), np.maximum(solid, 1)
    final = np.full(n, SPACE_CLASS)
    final[w_line] = kind[w_end - 1]  # the last word of a line is written last
    point = np.zeros(n, bool)
    point[w_line] = cp[w_end - 1] == ord(".")
    values = {
        "chars": (ends - starts).astype(np.float32),
        "words": words,
        "word_length": solid / one,
        "upper": each(kind == UPPER_CLASS) / np.maximum(letters, 1),
        "digits": each(kind == DIGIT_CLASS) / some,
        "marks": each(kind == MARK_CLASS) / some,
        "symbols": each(kind == SYMBOL_CLASS) / some,
        "bars": each(kind == BAR_CLASS) / some,
        "shouts": each(kind == SHOUT_CLASS) / some,
        "beyond_ascii": each(kind == OTHER_CLASS) / some,
        "repeats": np.bincount(w_line, same, minlength=n).astype(np.float32) / one,
        "common_words": np.bincount(w_line, known, minlength=n).astype(np.float32) / one,
        "ends": (point | (final == SHOUT_CLASS)).astype(np.float32),
        "copy": np.zeros(n, np.float32),
    }
    line_hash = np.where(words > 0, hashes(low, starts, ends) | np.uint64(1), np.uint64(0))
    return np.stack([values[k] for k in CUTS], axis=1).astype(np.float32), ends - starts, line_hash


def pieces(text: str) -> list[str]:
    """``text`` in parts of at most PIECE code points, cut at line ends where there are any."""
    out = []
    while len(text) > PIECE:
        at = text.rfind("\n", 0, PIECE + 1)
        out.append(text[:at] if at > 0 else text[:PIECE])
        text = text[at + 1 :] if at > 0 else text[PIECE:]
    return [*out, text]


def bits_of(texts: list[str], common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits of every line, its length, lines of each text)."""
    joined, sizes, found = [], 0, []
    n_lines = np.zeros(len(texts), np.int64)

    def flush() -> None:
        if joined:
            found.append(measures("\n".join(joined), common))

    for i, text in enumerate(texts):
        for part in pieces(text):
            if sizes + len(part) > PIECE:
                flush()
                joined, sizes = [], 0
            joined.append(part)
            sizes += len(part) + 1
            n_lines[i] += part.count("\n") + 1
    flush()
    x, length, key = (np.concatenate(parts) for parts in zip(*found))
    text_of = np.repeat(np.arange(len(texts)), n_lines)
    order = np.lexsort((np.arange(len(key)), key, text_of))
    again = np.zeros(len(key), bool)
    again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (text_of[order[1:]] == text_of[order[:-1]]) & (key[order[1:]] != 0)
    x[:, -1] = again
    bits = np.ones((len(x), WIDTH), np.uint8)
    bits[:, :-1] = x[:, _OF] > _CUT
    return bits, length, n_lines


# -- the field ----------------------------------------------------------------------------------


def marginals(logit: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probability of good for every line; ``logit``: of good against bad, ``moves``: between (bad, good), in logs."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    high = np.maximum(logit, 0)
    e = np.stack([np.exp(-high), np.exp(logit - high)], axis=1)
    step = np.exp(moves - moves.max())
    longer = np.searchsorted(-size, -np.arange(size[0]), side="left")
    alpha = np.empty_like(e)
    now = e[starts]
    alpha[starts] = now = now / now.sum(axis=1, keepdims=True)
    for t in range(1, size[0]):
        at = starts[: longer[t]] + t
        now = (now[: longer[t]] @ step) * e[at]
        now = now / now.sum(axis=1, keepdims=True)
        alpha[at] = now
    beta = np.ones((len(size), 2))
    for t in range(size[0] - 2, -1, -1):
        k = longer[t + 1]
        at = starts[:k] + t
        back = (e[at + 1] * beta[:k]) @ step.T
        beta[:k] = back / back.sum(axis=1, keepdims=True)
        alpha[at] *= beta[:k]
    return alpha[:, 1] / alpha.sum(axis=1)


class Model:
    """``weights``: rows for a line's own bits, those of the line before and those of the line after."""

    def __init__(self, common: np.ndarray, share: float = 0.5):
        self.common, self.share = common, share
        self.weights, self.moves = np.zeros((3, WIDTH)), np.zeros((2, 2))
        share = min(max(share, 1e-6), 1 - 1e-6)
        self.slope, self.offset = 0.0, float(np.log(share / (1 - share)))

    def logits(self, bits: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        own, before, after = (bits.astype(np.float32) @ self.weights.T.astype(np.float32)).T.astype(np.float64)
        starts = np.cumsum(lengths) - lengths
        out = own.copy()
        first, last = np.zeros(len(bits), bool), np.zeros(len(bits), bool)
        first[starts], last[starts + lengths - 1] = True, True
        out[1:] += np.where(first[1:], 0, before[:-1])
        out[:-1] += np.where(last[:-1], 0, after[1:])
        return out

    def good(self, bits: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return marginals(self.logits(bits, lengths), lengths, self.moves)

    def means(self, good: np.ndarray, size: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of each text, the mean over its lines by their sizes; by their number where all are empty."""
        starts = np.cumsum(lengths) - lengths
        total = np.add.reduceat(size, starts)
        weight = np.where(np.repeat(total, lengths) > 0, size, 1).astype(np.float64)
        return np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)

    @staticmethod
    def _squeezed(mean: np.ndarray) -> np.ndarray:
        p = np.clip(mean, 1e-3, 1 - 1e-3)
        return np.log(p / (1 - p))

    def score(self, mean: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self._squeezed(mean) + self.offset)))

    def fit(self, docs: list[np.ndarray], labels: list[np.ndarray], epochs: int, rate: float, seed: int, decay: float = 1e-4, batch: int = 64) -> Model:
        """Adagrad on the conditional likelihood of the line labels."""
        r = np.random.default_rng(seed)
        g_w, g_m = np.full((3, WIDTH), 1e-2), np.full((2, 2), 1e-2)
        for _ in range(epochs):
            for chosen in np.array_split(r.permutation(len(docs)), max(1, len(docs) // batch)):
                bits = np.concatenate([docs[i] for i in chosen]).astype(np.float64)
                lengths = np.array([len(docs[i]) for i in chosen])
                y = np.concatenate([labels[i] for i in chosen])
                logit = self.logits(bits, lengths)
                gap = y - marginals(logit, lengths, self.moves)
                first = np.zeros(len(y), bool)
                first[np.cumsum(lengths) - lengths] = True
                inner = np.flatnonzero(~first)
                before, after = np.zeros_like(gap), np.zeros_like(gap)
                before[inner - 1], after[inner] = gap[inner], gap[inner - 1]
                grad = np.stack([gap @ bits, before @ bits, after @ bits]) / len(chosen) - decay * self.weights
                move = np.zeros((2, 2))
                if len(inner):
                    np.add.at(move, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
                    move = (move - self._pairs(logit, lengths)) / len(chosen)
                g_w += grad**2
                g_m += move**2
                self.weights += rate * grad / np.sqrt(g_w)
                self.moves += rate * move / np.sqrt(g_m)
        return self

    def _pairs(self, logit: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Expected counts of the four transitions: the slope of the log of the normaliser, by central differences."""
        out, d = np.zeros((2, 2)), 1e-4
        for i in (0, 1):
            for j in (0, 1):
                up, down = self.moves.copy(), self.moves.copy()
                up[i, j] += d
                down[i, j] -= d
                out[i, j] = (log_sum(logit, lengths, up) - log_sum(logit, lengths, down)) / (2 * d)
        return out

    def calibrate(self, means: np.ndarray, labels: np.ndarray, weights: np.ndarray, steps: int = 50) -> None:
        """Newton steps for a logistic curve through the documents' means; a slope below zero is not taken."""
        x = np.stack([self._squeezed(means), np.ones(len(means))], axis=1)
        at = np.zeros(2)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(x @ at)))
            grad = x.T @ (weights * (labels - p)) - 1e-2 * at
            curve = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
            at = at + np.clip(np.linalg.solve(curve, grad), -1, 1)
        self.slope, self.offset = max(0.0, float(at[0])), float(at[1])


def log_sum(logit: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> float:
    """Log of the sum over all labellings of all sequences."""
    order = np.argsort(-lengths, kind="stable")
    starts, size = (np.cumsum(lengths) - lengths)[order], lengths[order]
    now = np.stack([np.zeros(len(size)), logit[starts]], axis=1)
    longer = np.searchsorted(-size, -np.arange(size[0]), side="left")
    total = 0.0
    for t in range(1, size[0]):
        k = longer[t]
        total += np.logaddexp(now[k:, 0], now[k:, 1]).sum()
        now = np.stack([np.logaddexp(now[:k, 0] + moves[0, j], now[:k, 1] + moves[1, j]) for j in (0, 1)], axis=1)
        now[:, 1] += logit[starts[:k] + t]
    return total + np.logaddexp(now[:, 0], now[:, 1]).sum()


def train(docs: list[tuple[int, np.ndarray, np.ndarray]], common: np.ndarray, share: float, rounds: int = 2, epochs: int = 6, rate: float = 0.2, seed: int = 5) -> Model:
    """From (label, bits of the lines, lengths of the lines) of each document; ``share``: of good ones among all that are labelled."""
    model = Model(common, share)
    if len({label for label, _, _ in docs}) < 2:
        return model
    bits, lengths = [b for _, b, _ in docs], np.array([len(b) for _, b, _ in docs])
    size = np.concatenate([s for _, _, s in docs])
    label = np.array([y for y, _, _ in docs], np.float64)
    marks = [np.full(len(b), y, np.float64) for y, b, _ in docs]
    for k in range(rounds):
        model = Model(common, share).fit(bits, marks, epochs, rate, seed + k)
        good = model.good(np.concatenate(bits), lengths)
        for i, own in enumerate(np.split(good, np.cumsum(lengths)[:-1])):
            if not label[i]:
                marks[i] = ((own > 0.5) & (own > own.min())).astype(np.float64)
    n_good = label.sum()
    weight = np.where(label > 0, share * len(label) / n_good, (1 - share) * len(label) / (len(label) - n_good))
    model.calibrate(model.means(good, size, lengths), label, weight)
    return model


# -- on Spark -----------------------------------------------------------------------------------


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def _windows(common: np.ndarray, window: int):
    def run(batches):
        for batch in batches:
            out = []
            for label, h, text in zip(*(c.to_pylist() for c in batch.columns)):
                bits, size, _ = bits_of([text or ""], common)
                at = h % max(1, len(bits) - window + 1)
                out.append((label, bits[at : at + window].tobytes(), size[at : at + window].astype(np.int64).tobytes()))
            columns = [pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int32(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["label", "bits", "size"])

    return run


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = 1500, window: int = 64, lexicon: int = 400, label_col: str = "quality") -> Model:
    """Learn from labelled documents (doc_id, text) outside the held-out fold."""
    known = labels.where(~held_out("doc_id") & F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("other"))
    known = known.where("label = other").select(F.col("doc_id").alias("id"), "label", F.xxhash64("doc_id").alias("h"))
    sizes = {r.label: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    total = sum(sizes.values())
    share = sizes.get(1, 0) / total if total else 0.5
    if len(sizes) < 2:
        return Model(np.zeros(0, np.uint64), share)
    # a hash cut leaves about twice what is wanted of a label, so that few rows are sorted
    chance = F.when(F.col("label") == 1, min(1.0, (2.0 * per_class + 50) / sizes[1])).otherwise(min(1.0, (2.0 * per_class + 50) / sizes[0]))
    part = F.pmod(F.col("h"), F.lit(1_000_000)) / 1e6
    rank = F.row_number().over(W.partitionBy("label").orderBy("h", "id"))
    some = known.where(part <= chance).withColumn("rank", rank).where(F.col("rank") <= per_class).drop("rank")
    some = F.broadcast(some)  # at most per_class rows of each label
    own = docs.select("doc_id", "text").join(some, F.col("doc_id") == F.col("id"))
    one = F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    own = own.withColumn("k", one).where("k = 1").select("label", F.pmod("h", F.lit(1 << 30)).alias("h"), "text")
    words = own.where("label = 1").select(F.explode(F.array_distinct(space_words(F.lower("text")))).alias("word"))
    plain = words.select(F.regexp_replace("word", r"[^\p{L}\p{Nd}]{1,3}$", "").alias("word")).where("word <> ''")
    counts = plain.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    frequent = counts.orderBy(F.desc("n"), "word").limit(lexicon).collect()
    common = np.array(sorted(word_hash(r.word) for r in frequent), np.uint64)
    rows = own.mapInArrow(_windows(common, window), "label int, bits binary, size binary").collect()
    found = sorted((r.label, bytes(r.bits), bytes(r.size)) for r in rows)
    return train([(y, np.frombuffer(b, np.uint8).reshape(-1, WIDTH), np.frombuffer(s, np.int64)) for y, b, s in found], common, share)


LINES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("good", pa.float64())]))


def _scores(model: Model, lines: bool, most: int = 4_000_000):
    def slices(texts: list[str]):
        at, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size > most or i == len(texts) - 1:
                yield texts[at : i + 1]
                at, size = i + 1, 0

    def run(batches):
        for batch in batches:
            scores, spans = [], []
            for some in slices([t or "" for t in batch.column(0).to_pylist()]):
                bits, size, lengths = bits_of(some, model.common)
                good = model.good(bits, lengths)
                scores.append(model.score(model.means(good, size, lengths)))
                if lines:
                    for text, g, s in zip(some, np.split(good, np.cumsum(lengths)[:-1]), np.split(size, np.cumsum(lengths)[:-1])):
                        spans.append([])
                        at = 0
                        for p, n in zip(g.tolist(), s.tolist()):
                            spans[-1].append({"start": at, "end": at + n, "good": p})
                            at += n + (text[at + n : at + n + 1] == "\n")
            found = pa.array(np.concatenate([*scores, np.zeros(0)]), pa.float64())
            more = [pa.array(spans, LINES)] if lines else []
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], found, *more], [*batch.schema.names[1:], "score", *["lines"] * lines])

    return run


def line_quality(docs: DataFrame, model: Model, lines: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score of every row and, if asked for, its ``lines`` (start, end, probability of good)."""
    source = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"))
    kind = source.schema["doc_id"].dataType.simpleString()
    more = ", lines array<struct<start:bigint,end:bigint,good:double>>" if lines else ""
    return source.mapInArrow(_scores(model, lines), f"doc_id {kind}, held_out boolean, score double{more}")


@register("op13_line_quality")
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fitted(docs, table(spark, sf_dir, "labels"))
    return line_quality(docs, model).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
