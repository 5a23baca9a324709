"""Personal data in texts: candidates by generators, boosted trees to judge them, calibrated thresholds to redact.

Four base kinds (email, ip, card, phone) are found by fixed patterns and always stand. Generators of high recall propose
further, overlapping spans of any length: keys with values, long mixed tokens, national phone numbers, social security numbers, IBANs, MAC and
IPv6 addresses, obscured mail addresses. Boosted trees score each from its format and its
context; a span stands if its score reaches the threshold of its generator, which is set on held-out examples so that at
most ``false_rate`` of the negative ones pass. Of overlapping spans the base wins, then the higher score; 16 or more characters of the
other that are left stand in pieces.

The trees are fitted on the driver on at most ``examples`` generated spans, written by format grammars into the words of
at most ``sample`` documents (the smallest by a hash of the id); the model is a few kilobytes and travels with the tasks. Texts are
scanned whole, row by row, in Arrow batches, without a shuffle.

A null or empty text has no spans; ``redacted`` keeps a null text null. Positions are code points, ends exclusive. Repeated rows and
null ids are each scanned. Other columns are kept by ``redacted`` and not looked at.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.base import hash_sample, space_words, table
from docloom.llm.registry import register

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ipv6", "mac", "mail_like", "national", "secret", "ssn", "token")
KINDS = (*BASE, *ADDED)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a start inside a run of digits matches exactly where the start of the run does, so only that is tried
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

VALUE = re.compile(r"[=:][ ]?[\"']?([^\s\"',;=]{4,}+)")
KEY = re.compile(r"[A-Za-z0-9_-]*\Z")
SIGN = re.compile(r"[=:]")
TOKEN = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+")
NATIONAL = re.compile(r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{4}(?![0-9-])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
MAC = re.compile(r"(?<![0-9A-Fa-f:-])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:-])")
IPV6 = re.compile(
    r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])"
)
MAIL_LIKE = re.compile(r"[A-Za-z0-9._+-]{2,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{2,64} ?(?:[\[(] ?dot ?[\])]|\.) ?[A-Za-z]{2,16}")
DIGIT = re.compile(r"[0-9]")

# Words before a span that speak for a kind of data.
CUES = {
    "secret": ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "login"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "whatsapp"),
    "money": ("iban", "account", "bank", "konto", "card", "visa"),
    "person": ("ssn", "social", "security", "passport", "born", "tax"),
    "net": ("mac", "ip", "host", "address", "addr", "device"),
    "mail": ("mail", "contact", "write", "reach"),
    "other": ("order", "version", "page", "item", "part", "isbn", "width", "height", "size", "date", "ratio", "build", "sku", "color"),
}


# -- base ----------------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain: a match begins with the run of local characters before an @."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        free = max(free, at + 1)
        at = text.find("@", free)
    return out


def base_spans(text: str, digits: bool | None = None) -> list[tuple[str, int, int]]:
    """``digits``: whether the text has any, if that is known."""
    out = [("email", a, b) for a, b in emails(text)]
    if not (DIGIT.search(text) if digits is None else digits):
        return out
    if "." in text:
        for m in IP.finditer(text):
            if all(int(p[-9:]) <= 255 and not p[:-9].strip("0") for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# -- candidates ----------------------------------------------------------------------------------


def values(text: str) -> list[tuple[int, int]]:
    """Values of four characters or more after a key and = or :, leftmost ones first, none inside another with its key.

    A key is a letter and up to 40 letters, digits, _ and -, a quote or a space may follow. Looked for from the sign, as few texts have
    one, while every letter may begin a key.
    """
    out, free, at = [], 0, 0
    while sign := SIGN.search(text, at):
        end, at = sign.start(), sign.end()
        if end > free and text[end - 1] == " ":
            end -= 1
        if end > free and text[end - 1] in "\"'":
            end -= 1
        key = KEY.search(text, max(free, end - 41), end)[0]
        if any(c.isalpha() for c in key) and (m := VALUE.match(text, sign.start())):
            out.append(m.span(1))
            free = at = m.end()
    return out


def candidates(text: str, digits: bool | None = None) -> list[tuple[str, int, int]]:
    """Spans that might be personal data or secrets; they may overlap. ``digits``: whether the text has any, if that is known."""
    out = []
    if "=" in text or ":" in text:
        out += [("secret", a, b) for a, b in values(text)]
    if ":" in text or "-" in text:
        out += [("mac", m.start(), m.end()) for m in MAC.finditer(text)]
    if "::" in text or text.count(":") > 2:
        out += [("ipv6", m.start(), m.end()) for m in IPV6.finditer(text)]
    if "at]" in text or "at)" in text or "at ]" in text or "at )" in text:
        out += [("mail_like", m.start(), m.end()) for m in MAIL_LIKE.finditer(text)]
    if DIGIT.search(text) if digits is None else digits:
        out += [("token", m.start(), m.end()) for m in TOKEN.finditer(text) if DIGIT.search(m[0])]
        out += [("national", m.start(), m.end()) for m in NATIONAL.finditer(text)]
        if "-" in text:
            out += [("ssn", m.start(), m.end()) for m in SSN.finditer(text)]
        out += [("iban", m.start(), m.end()) for m in IBAN.finditer(text)]
    return out


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return s.isalnum() and s.isascii() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    s = text[start:end]
    n = len(s)
    m = min(n, 256)  # what grows with the length is as in a span of 256; the whole span is looked at
    counts = Counter(s)
    digits, upper = sum(c.isdigit() for c in s), sum(c.isupper() for c in s)
    lower = sum(c.islower() for c in s)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    before = text[max(0, start - 40) : start].lower()
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:]))
    vowels = sum(c in "aeiouAEIOU" for c in s)
    return [
        float(ADDED.index(kind)),
        m,
        digits / n,
        upper / n,
        lower / n,
        (n - digits - upper - lower) * m / n,
        entropy,
        len(counts) / m,
        turns * m / n,
        vowels / max(upper + lower, 1),
        float(all(c in "0123456789abcdefABCDEF" for c in s)),
        float(kind == "iban" and _mod97(s)),
        float(start > 0 and text[start - 1] in "=:\"'"),
        float(end < len(text) and text[end : end + 1].isalnum()),
        *[float(any(w in before for w in words)) for words in CUES.values()],
    ]


# -- boosted trees -------------------------------------------------------------------------------


class BoostedTrees:
    """Logistic boosting of shallow trees over binned features."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        grid = np.linspace(0, 1, self.bins + 1)[1:-1]
        edges = [np.unique(np.quantile(x[:, j], grid)) for j in range(x.shape[1])]
        codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        score = np.zeros(len(x))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._tree(codes, edges, p - y, p * (1 - p))
            self.trees.append(tree)
            score += self._one(tree, x)
        return self

    def _tree(self, codes, edges, grad, hess):
        n = 2**self.depth - 1
        feature, cut, leaf = np.full(n, -1), np.zeros(n), np.zeros(2 ** (self.depth + 1) - 1)
        todo = [(0, np.arange(len(codes)))]
        while todo:
            node, rows = todo.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            leaf[node] = -self.rate * g / (h + self.ridge)
            if node >= n or len(rows) < 8:
                continue
            best = (1e-3, -1, 0)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                gs = np.cumsum(np.bincount(codes[rows, j], grad[rows], len(e) + 1))[:-1]
                hs = np.cumsum(np.bincount(codes[rows, j], hess[rows], len(e) + 1))[:-1]
                gain = gs**2 / (hs + self.ridge) + (g - gs) ** 2 / (h - hs + self.ridge) - g**2 / (h + self.ridge)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
            if best[1] >= 0:
                _, j, k = best
                feature[node], cut[node] = j, edges[j][k]
                left = codes[rows, j] <= k
                todo += [(2 * node + 1, rows[left]), (2 * node + 2, rows[~left])]
        return feature, cut, leaf

    def _one(self, tree, x):
        feature, cut, leaf = tree
        node = np.zeros(len(x), int)
        for _ in range(self.depth):
            inner = node < len(feature)
            f = np.where(inner, feature[np.minimum(node, len(feature) - 1)], -1)
            go = f >= 0
            right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[np.minimum(node, len(cut) - 1)]
            node = np.where(go, 2 * node + 1 + right, node)
        return leaf[node]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-sum(self._one(t, x) for t in self.trees)))


class Model:
    def __init__(self, trees: BoostedTrees, thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def spans(self, text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, float]]]:
        """(base spans, added spans with their scores), each sorted by kind and start."""
        return self.spans_of([text])[0]

    def spans_of(self, texts: list[str | None]) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int, float]]]]:
        """``spans`` of each text. The candidates of all of them pass the trees together, as a pass for each text costs more than its spans."""
        base, found, x = [], [], []
        for text in texts:
            digits = bool(text) and DIGIT.search(text) is not None
            base.append(base_spans(text, digits) if text else [])
            found.append(candidates(text, digits) if text else [])
            x += [features(text, *c) for c in found[-1]]
        scores = self.trees.score(np.array(x)).tolist() if x else []
        order = {k: i for i, k in enumerate(KINDS)}
        out, at = [], 0
        for own, some in zip(base, found):
            kept: list[tuple[str, int, int, float]] = []
            if some:
                ranked = sorted((-s, c) for s, c in zip(scores[at : at + len(some)], some) if s >= self.thresholds[c[0]])
                kept = _apart(ranked, sorted((a, b) for _, a, b in own))
                at += len(some)
            out.append((sorted(own, key=lambda s: (order[s[0]], s[1])), sorted(kept, key=lambda s: (order[s[0]], s[1]))))
        return out


def _apart(ranked, taken, least: int = 16):
    """The ranked spans where no better one stands; ``taken``: sorted spans that stand already.

    Of a span that better ones cover in part, the rest stands in pieces if it has ``least`` characters or more: a long secret is not
    let through for a card number among its digits.
    """
    import bisect

    own: list[tuple[int, int]] = []  # disjoint, sorted
    for a, b in taken:
        if own and a < own[-1][1]:
            own[-1] = (own[-1][0], max(own[-1][1], b))
        else:
            own.append((a, b))
    kept = []
    for score, (kind, a, b) in ranked:
        i, j = bisect.bisect_left(own, (a, a)), bisect.bisect_left(own, (b, 0))
        if i and own[i - 1][1] > a:
            i -= 1
        ends = [a, *[x for span in own[i:j] for x in span], b]
        free = [(x, y) for x, y in zip(ends[::2], ends[1::2]) if x < y]
        if i < j and sum(y - x for x, y in free) < least:
            continue
        own[i:j] = sorted([*own[i:j], *free])
        kept += [(kind, x, y, float(-score)) for x, y in free]
    return kept


# -- examples ------------------------------------------------------------------------------------


def _write(r: random.Random, pattern: str) -> str:
    """9: a digit, A: a capital, a: a small letter, x: a hex digit, *: any of letters and digits."""
    sets = {"9": "0123456789", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "a": "abcdefghijklmnopqrstuvwxyz", "x": "0123456789abcdef"}
    sets["*"] = sets["9"] + sets["A"] + sets["a"]
    return "".join(r.choice(sets[c]) if c in sets else c for c in pattern)


def _iban(r: random.Random) -> str:
    country, tail = r.choice(["DE", "FR", "ES", "GB", "NL"]), _write(r, "9" * r.choice([14, 16, 18]))
    rest = int("".join(str(int(c, 36)) for c in tail + country + "00")) % 97
    s = f"{country}{98 - rest:02d}{tail}"
    return s if r.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))


def _long(r: random.Random) -> int:
    """A length between 64 and 5,000, short ones more often."""
    return int(64 * (5000 / 64) ** r.random())


def example(r: random.Random, positive: bool) -> tuple[str, str]:
    """(what stands before the span, the span) of one generated case."""
    pick = r.choice
    if positive:
        lead, span = pick(
            [
                lambda: (pick(["password", "passwd", "pwd", "secret", "api_key", "token", "auth", "PASSWORD"]) + pick(["=", ": ", ":", " = "]), _write(r, pick(["x" * r.randint(8, 40), "*" * r.randint(8, 24), "aaaa99", "Aaaaaa99", "aaaaaaaa", "*" * _long(r), "x" * _long(r)]))),
                lambda: (pick(["", "key ", "bearer ", "token "]), pick(["AKIA" + _write(r, "*" * 16).upper(), "ghp_" + _write(r, "*" * 36), "sk-" + _write(r, "*" * 40), _write(r, "*" * 32), "eyJ" + _write(r, "*" * 60), _write(r, pick("*x") * _long(r)), "eyJ" + _write(r, "*" * _long(r))])),
                lambda: (pick(["call ", "phone ", "tel ", "mobile ", "", ""]), _write(r, pick(["(999) 999-9999", "999-999-9999", "999.999.9999", "999 999 9999"]))),
                lambda: (pick(["ssn ", "social security ", "", "ssn: "]), _write(r, "999-99-9999")),
                lambda: (pick(["iban ", "account ", "", "bank "]), _iban(r)),
                lambda: (pick(["mac ", "device ", "", "address "]), _write(r, pick(["xx:xx:xx:xx:xx:xx", "xx-xx-xx-xx-xx-xx"]))),
                lambda: (pick(["host ", "ip ", "address ", ""]), _write(r, pick(["xxxx:xxxx:xxxx:xxxx:xxxx:xxxx:xxxx:xxxx", "xxxx:xxxx::xxxx", "fe80::xxxx:xxxx"]))),
                lambda: (pick(["mail ", "contact ", "write to ", ""]), pick(["{} (at) {} (dot) com", "{}.{} [at] {} [dot] org", "{}(at){}.net"]).format(*[_write(r, "a" * r.randint(4, 9)) for _ in range(3)])),
            ]
        )()
        return lead, span
    return pick(
        [
            lambda: (pick(["width", "height", "size", "color", "ratio", "page", "version", "note", "lang", "mode"]) + pick(["=", ": ", ":", " = "]), _write(r, pick(["9999", "9.99", "aaaaaa", "aaaaaaaaa", "99999", "aaaa-aaaa", "aaaa/aaaa"]))),
            lambda: (pick(["see", "note", "thus", "said", "that is"]) + pick([": ", ":"]), _write(r, "a" * r.randint(4, 12))),
            lambda: (pick(["", "part ", "item ", "sku ", "the "]), _write(r, pick(["a" * 8 + "-" + "a" * 8 + "9", "aaaaaaaaaaaaaaaaaaa9", "Aaaaaaaa-aaaaaaaa-99", "9" * 18, "aaaa/aaaa/aaaaa/a99", "aaaaaa-aaaaaaaa/" * (_long(r) // 16) + "a9"]))),
            lambda: (pick(["order ", "version ", "build ", "isbn ", "page "]), _write(r, pick(["9999 9999 9999", "99 9999 9999", "999-9999-9999", "9999.999.9999"]))),
            lambda: (pick(["order ", "part ", "item ", "sku "]), _write(r, "999-99-9999")),
            lambda: (pick(["", "item ", "order "]), _write(r, pick(["AA99 AAAA AAAA", "AA99AAAAAAAA9", "AA99 9999 9999 9999"]))),
            lambda: (pick(["at ", "time ", ""]), _write(r, pick(["99:99:99", "9:99:99:99"]))),
            lambda: (pick(["date ", "order ", "build "]), _write(r, pick(["99-99-99-99-99-99"]))),
        ]
    )()


def train(words: list[str], examples: int = 4000, false_rate: float = 0.01, seed: int = 7) -> Model:
    """Fit on generated spans among ``words``; three fifths for the trees, the rest for the thresholds."""
    r = random.Random(seed)
    words = words or ["and"]
    rows, labels = [], []
    while len(rows) < examples:
        positive = r.random() < 0.5
        lead, span = example(r, positive)
        some = lambda: " ".join(r.choice(words) for _ in range(r.randint(3, 8)))
        left = f"{some()} {lead}"
        text = f"{left}{span} {some()}"
        a, b = len(left), len(left) + len(span)
        for kind, s, e in candidates(text):
            if s < b and e > a:
                rows.append(features(text, kind, s, e))
                labels.append(float(positive and s <= a + 1 and e >= b - 1))
    x, y = np.array(rows), np.array(labels)
    fit = np.arange(len(x)) % 5 < 3
    trees = BoostedTrees().fit(x[fit], y[fit])
    held, truth, kind = trees.score(x[~fit]), y[~fit], x[~fit][:, 0].astype(int)
    thresholds = {}
    for i, name in enumerate(ADDED):
        wrong = np.sort(held[(kind == i) & (truth == 0)])
        most = wrong[min(len(wrong) - 1, int(len(wrong) * (1 - false_rate)))] if len(wrong) else 0.0
        thresholds[name] = float(max(0.5, np.nextafter(most, 2)))
    return Model(trees, thresholds)


def fitted(docs: DataFrame, sample: int = 256, examples: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model whose examples stand among the words of at most ``sample`` documents, 100 words of each."""
    w = space_words(F.col(text_col))
    at = F.pmod(F.xxhash64(F.col(id_col)), F.greatest(F.size(w) - 100, F.lit(1))).cast("int") + 1
    known = docs.where(F.col(text_col).isNotNull())
    some = hash_sample(known, F.col(id_col), sample, docs.select(id_col).count())
    some = some.select(F.xxhash64(id_col, text_col).alias("h"), F.slice(w, at, 100).alias("w"))
    rows = some.orderBy("h").limit(sample).collect()  # ``sample`` rows of 100 words
    return train([x for row in rows for x in row.w if x.isalpha()], examples)


def _some(texts: pa.Array, most: int = 1024):
    """The texts of a column, a bounded number at a time."""
    for at in range(0, len(texts), most):
        yield texts.slice(at, most).to_pylist()


def _scan(model: Model):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            base, added = [], []
            for some in _some(batch.column(1)):
                for b, a in model.spans_of(some):
                    base.append([{"kind": k, "start": s, "end": e, "score": 1.0} for k, s, e in b])
                    added.append([{"kind": k, "start": s, "end": e, "score": p} for k, s, e, p in a])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(added, kind)], ["doc_id", "base", "added"])

    return run


def personal_data(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ``base`` and ``added`` spans (kind, start, end, score) of every row."""
    model = model or fitted(docs, id_col=id_col, text_col=text_col)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    spans = "array<struct<kind:string,start:int,end:int,score:double>>"
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_scan(model), f"doc_id {kind}, base {spans}, added {spans}")


def redact(text: str | None, model: Model) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping ones become one."""
    return redact_all([text], model)[0]


def redact_all(texts: list[str | None], model: Model) -> list[str | None]:
    done = []
    for text, (base, added) in zip(texts, model.spans_of(texts)):
        out, at = [], 0
        for a, b, kind in sorted([(a, b, k) for k, a, b in base] + [(a, b, k) for k, a, b, _ in added]):
            if a >= at:
                out += [text[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        done.append("".join(out) + text[at:] if out else text)
    return done


def redacted(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in ``text_col``; every row and column stays."""
    model = model or fitted(docs, id_col=id_col, text_col=text_col)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = pa.array([t for some in _some(batch.column(at)) for t in redact_all(some, model)], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


@register("op3_personal")
def op3(spark, sf_dir):
    found = personal_data(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(line("base"), 256).alias("base_sha256"),
        line(F.concat("base", "added")).alias("spans"),
    )
