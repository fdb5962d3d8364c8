"""Personal data: candidate spans, gradient boosted trees, calibrated thresholds.

Base patterns find the plain forms; their spans always stay. Generators of high recall propose
further, overlapping spans in looser forms (obfuscated addresses, other separators, numbers without
a country code, one number out of several in a row). Boosted trees score each proposal by its format
and its context; of each kind, those whose calibrated probability reaches the kind's threshold join
the base spans, best score first, if they overlap no span of that kind.

The trees are trained here, on labelled snippets that :func:`training_snippets` makes from rules and
a seed: personal data of all kinds, and what is mistaken for it (versions, dates, prices, order
numbers, hashes). The forms of each kind are dealt into three sets (:data:`FORMS`): the trees learn
from the first; a logistic curve and each kind's threshold, the lowest probability that reaches the
target precision, come from the first two, of which the trees have not seen the second; the third
is for measuring recall alone.
"""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failscope.llm.common import table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a digit before the first one would belong to the match, so the look-behind changes no match
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: Looser forms. What stands inside one match is proposed too, see :func:`proposals`.
_LOOSE_AT = re.compile(r"\x20?(?:[(\[{<]\x20?(?:at|@)\x20?[)\]}>]|@)\x20?|\x20at\x20", re.IGNORECASE)
_SPELT_DOT = r"\x20?[(\[{<]\x20?(?:dot|\.)\x20?[)\]}>]\x20?|\x20dot\x20"
_LOOSE_LABEL = re.compile(rf"(?:{_SPELT_DOT}|\x20?\.\x20?)([A-Za-z0-9-]{{2,63}})", re.IGNORECASE)
_SPELT_LABEL = re.compile(rf"(?:{_SPELT_DOT})([A-Za-z0-9-]{{2,63}})", re.IGNORECASE)
_FIRST_LABEL = re.compile(r"[A-Za-z0-9-]{1,63}")
_LOOSE_IP = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,4}(?:\x20?(?:[.,\[\]()]{1,3}|[(\[]dot[)\]])\x20?[0-9]{1,4}){3}(?![0-9A-Za-z])", re.IGNORECASE)
#: A group of digits, and what may stand between two groups of one card or phone number.
_GROUP = re.compile(r"(?<![0-9A-Za-z])[0-9]++(?![0-9A-Za-z])")
_CARD_LINK = re.compile(r"[\x20._/-]{1,2}")
_PHONE_LINK = re.compile(r"[\x20()./-]{1,2}")
_ANY = re.compile(r"[0-9@]|[(\[{<]\x20?at|\x20at\x20", re.IGNORECASE)

PRECISION = 0.98
CONTEXT = 24
SEED = 11


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns, by kind and start; matches that fail their check are dropped."""
    out = []
    edge, at = 0, text.find("@")
    while at >= 0:
        run = text[edge:at]
        begin = at - (len(run) - len(run.rstrip(_LOCAL)))
        match = _DOMAIN.match(text, at + 1) if begin < at else None
        if match:
            out.append(("email", begin, match.end()))
        edge = match.end() if match else at + 1
        at = text.find("@", edge)
    if not _HAS_DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(m.group().count, string.digits)) <= 15]
    return out


_HAS_DIGIT = re.compile("[0-9]")


def _linked(text: str, groups: list[tuple[int, int]], link: re.Pattern) -> list[bool]:
    """For each group of digits, whether the next one may belong to the same number."""
    return [link.fullmatch(text, a[1], b[0]) is not None for a, b in zip(groups, groups[1:], strict=False)] + [False]


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Overlapping candidate spans of all kinds, in order and without repeats."""
    if not _ANY.search(text):
        return []
    found = {}
    for m in _LOOSE_AT.finditer(text):
        head = text[max(0, m.start() - 64) : m.start()]
        begin = m.start() - len(head) + len(head.rstrip(_LOCAL))
        first = _FIRST_LABEL.match(text, m.end())
        if begin == m.start() or first is None:
            continue
        # the word "at" alone is no address, unless the dots are spelt out too
        label, at = _SPELT_LABEL if m.group().lower() == " at " else _LOOSE_LABEL, first.end()
        for _ in range(4):
            if (more := label.match(text, at)) is None:
                break
            at = more.end()
            found["email", begin, at] = None
            if text[at - 1] == "-":
                found["email", begin, at - len(more.group()) + len(more.group().rstrip("-"))] = None
    for m in _LOOSE_IP.finditer(text):
        if all(int(x) <= 255 for x in re.findall("[0-9]+", m.group())):
            found["ip", m.start(), m.end()] = None
    groups = [m.span() for m in _GROUP.finditer(text)]
    # runs of groups that together have as many digits as a card
    linked = _linked(text, groups, _CARD_LINK)
    for i, (begin, _) in enumerate(groups):
        n = 0
        for j in range(i, len(groups)):
            n += groups[j][1] - groups[j][0]
            if n > 19:
                break
            if n >= 13:
                found["card", begin, groups[j][1]] = None
            if not linked[j]:
                break
    linked = _linked(text, groups, _PHONE_LINK)
    for i, (begin, first) in enumerate(groups):
        # runs of groups that together have as many digits as a phone number, with its + or bracket
        most = 17 if first - begin > 2 and text.startswith("00", begin) else 15
        start = begin - (text[begin - 1 : begin] in ("+", "(") and not text[max(0, begin - 2) : begin - 1].isalnum())
        n = 0
        for j in range(i, len(groups)):
            n += groups[j][1] - groups[j][0]
            if n > most:
                break
            if n >= 7:
                found["phone", start, groups[j][1]] = None
            if not linked[j]:
                break
    return list(found)


#: Words that stand near data of a kind.
CUES = {
    "email": ("mail", "contact", "write", "@", "address"),
    "ip": ("ip", "host", "server", "address", "addr", "login", "client"),
    "card": ("card", "visa", "credit", "amex", "payment", "pay", "cc"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "whatsapp"),
}
#: Words that stand near what is mistaken for personal data.
OTHER_CUES = ("version", "release", "order", "invoice", "isbn", "section", "page", "price", "total", "id", "no", "sku", "rev", "date", "chapter")


def features(text: str, span: tuple[str, int, int]) -> list[float]:
    """Format and context of a candidate."""
    kind, begin, end = span
    body = text[begin:end]
    before, after = text[max(0, begin - CONTEXT) : begin].lower(), text[end : end + CONTEXT].lower()
    words = set(re.findall(r"[a-z]+|@", before))
    digits = _NOT_DIGIT.sub("", body)
    groups = re.findall("[0-9]+", body)
    numbers = [int(g[:6]) for g in groups]
    separators = set(re.findall(r"[^0-9A-Za-z]", body))
    domain = re.split(r"@|[\[({]at[\])}]", body.lower())[-1].strip()
    last = re.split(r"[^a-z0-9-]+", domain.strip())[-1]
    return [
        KINDS.index(kind), len(body), len(digits), len(groups), float(luhn(digits)) if digits else 0.0, max(numbers, default=0), min(numbers, default=0),
        min((len(g) for g in groups), default=0), max((len(g) for g in groups), default=0), float(body.startswith("+")), float("(" in body), len(separators),
        float(" " in separators), float("-" in separators), float("." in separators), float("/" in separators), float("," in separators),
        float("@" in body), float("dot" in body.lower()), len(last), float(last.isalpha()), float("." in domain or "dot" in domain),
        float(bool(words & set(CUES[kind]))), float(bool(words & set(OTHER_CUES))), float(bool(re.match(r"\s?[0-9]", after))), float(bool(re.search(r"[0-9]\s?$", before))),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in "$€£#=v"), float(after[:1] in "%€$"),
        len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0, len(groups[-2]) if len(groups) > 1 else 0, body.find("("),
        float(bool(re.search(r"(?:\+|\b00)[0-9]{1,3}[\x20./-]?$", before))), float(bool(re.search(r"[0-9)][./-]$", before))), float(bool(re.match(r"[)./-]\x20?[0-9]", after))), float(bool(re.match(r"\x20?\([0-9]", after))),
        float(bool(re.search(r"\)\x20?$", before))), len(re.findall(r"\x20", body)), max((len(x) for x in re.split(r"\x20", body)), default=0), float(bool(re.search(r"[./-]", body.split(" ")[0]))), float("." in body.split(" ")[-1]),
        float(bool(re.match(r"\x20?(?:[(\[{<]\x20?(?:dot\b|\.)|\x20dot\x20|\.[a-z0-9])", after))), float(bool(re.search(r"\bat\b", body.lower()))), float(bool(re.search(r"[\[({<]", body))),
    ]


#: Forms of each kind: those that trees learn, those that calibrate, those that only measure. Phones:
#: numbers of digits, a zero stands for itself. Addresses: at and dot. Others: what stands between the groups.
FORMS = {
    "email": (("@|.", "@|.", " (at) |.", "(at)|(dot)", "[at]|[dot]", " [at] | [dot] ", " at | dot "), (" {at} | {dot} ", "(at)|.", " (at) | (dot) "), ("{at}|{dot}", "[@]|[.]", " <at> | <dot> ", " at | (dot) ")),
    "ip": ((".", ".", "[.]"), ("(.)", " . "), ("[dot]", "(dot)")),
    "card": (("", "", " ", "-", ".", "/", "_"), ("465 ", "465-", " -"), ("465.", "465/", "- ", ". ")),
    "phone": (("+1 (3) 3-4", "(3) 3-4", "(3) 3-4", "+2 3 4 3", "002 3 7", "3-3-4", "02 4 4", "02/7", "3.3.4", "1-3-3-4", "01 2 2 2 2", "03 6"), ("03-6", "(4) 6", "02 3 2 2", "(02) 7"), ("02-4-4", "(02) 4-4", "03/6", "002-3-7")),
}


def training_snippets(n: int = 6000, seed: int = SEED, forms: int = 0) -> list[tuple[str, tuple[str, int, int], int]]:
    """(text, candidate span, label) from rules: a candidate, that is a
    proposal beside the base spans, is personal data if it is the span that was put in. ``forms``: the set of :data:`FORMS` that is used."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    word = lambda: "".join(pick(string.ascii_lowercase) for _ in range(int(rng.integers(2, 10))))

    def card(form: str) -> str:
        sizes = (4, 6, 5) if form.startswith("465") else (4, 4, 4, 4)
        body = (pick("34567") if sizes[0] == sizes[1] else "3") + num(sum(sizes) - 2)
        body += next(d for d in string.digits if luhn(body + d))
        parts = [body[sum(sizes[:i]) : sum(sizes[: i + 1])] for i in range(len(sizes))]
        return form.removeprefix("465").join(parts)

    def email(form: str) -> str:
        at, dot = form.split("|")
        zone = pick(["com", "net", "org", "de", "fr", "io", "co.uk"]).replace(".", dot)
        return f"{word()}{pick(['', '.', '_'])}{word()}{pick(['', num(2)])}{at}{word()}{dot}{zone}"

    def phone(form: str) -> str:
        return re.sub("[0-9]", lambda m: pick("123456789") + num(int(m.group()) - 1) if m.group() != "0" else "0", form)

    def address(form: str) -> str:
        return form.join(str(int(x)) for x in rng.integers(1, 256, 4))

    def mistaken() -> str:
        return pick([
            f"version {num(1)}.{num(1)}", f"{num(1)}.{num(2)}.{num(4)}.{num(3)}", f"20{num(2)}-0{num(1)}-1{num(1)}", f"${num(3)},{num(3)}.{num(2)}", f"order {num(8)}", f"id {num(12)}", num(int(rng.integers(4, 30))),
            "".join(pick("0123456789abcdef") for _ in range(40)), f"ISBN 978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"{num(3)}.{num(3)}.{num(3)},{num(2)}", f"{num(4)}/{num(4)}/{num(4)}", f"section {num(1)}.{num(1)}.{num(1)}.{num(1)}.{num(1)}",
            f"{word()} @ {num(2)}.{num(2)}", f"{num(5)} {num(5)} {num(5)}", f"page {num(3)}", f"{num(1)}, {num(2)}, {num(3)}, {num(4)}", f"0.{num(9)}", f"{num(4)} {num(4)} {num(4)} {num(4)}",
            f"{word()} at {word()} dot {word()}{word()}{word()}", f"{word()} at {word()}. {word()}", f"{num(3)} {num(3)} {num(3)} {num(3)}", f"{num(2)}/{num(2)}/20{num(2)}", f"{num(2)}:{num(2)}:{num(2)}", f"{num(3)}-{num(2)}", f"{num(4)}-{num(4)}", f"{num(1)}.{num(3)}.{num(3)}", f"1{num(3)} 1{num(3)} 20{num(2)}", f"{num(4)}-{num(6)}-{num(5)}", f"{num(5)}/{num(4)}/{num(6)}", f"{num(3)}.{num(6)}.{num(4)}",
        ])

    makers = {k: lambda m=m, k=k: m(pick(FORMS[k][forms])) for k, m in (("email", email), ("ip", address), ("card", card), ("phone", phone))}
    out = []
    for _ in range(n):
        lead = " ".join(word() for _ in range(int(rng.integers(0, 5))))
        tail = " ".join(word() for _ in range(int(rng.integers(0, 5))))
        kind = pick([*KINDS, None])
        cue = f" {pick(CUES[kind])}{pick([' ', ': '])}" if kind and rng.random() < 0.3 else " "
        body = makers[kind]() if kind else mistaken()
        text = f"{lead}{cue}"
        if kind and rng.random() < 0.15:  # what else may stand close by
            text += (mistaken() if rng.random() < 0.5 else num(int(rng.integers(1, 4)))) + " "
        right = {(kind, len(text), len(text) + len(body))}
        text += body + " "
        if kind and rng.random() < 0.3:
            other = pick([None, None, None, kind, *KINDS])
            beside = makers[other]() if other else pick([mistaken(), num(int(rng.integers(1, 4)))])
            right.add((other, len(text), len(text) + len(beside)))
            text += beside + " "
        text += tail
        base = {k: [x[1:] for x in base_spans(text) if x[0] == k] for k in KINDS}
        out += [(text, span, int(span in right)) for span in proposals(text) if not _overlaps(base[span[0]], *span[1:])]
    return out


@dataclass
class Detector:
    """For each kind: boosted trees over binned features, a logistic curve, and a threshold."""

    edges: list[np.ndarray]
    trees: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]  # per tree: feature and bin of each inner node, leaf values
    start: dict[str, float]
    curves: dict[str, tuple[float, float]]
    thresholds: dict[str, float]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1)

    def margins(self, x: np.ndarray, kind: str) -> np.ndarray:
        bins = self.binned(x)
        total = np.full(len(x), self.start[kind])
        for feature, cut, leaf in self.trees[kind]:
            node = np.zeros(len(x), dtype=np.int64)
            while len(node) and node[0] < len(feature):
                node = 2 * node + 1 + (bins[np.arange(len(x)), feature[node]] > cut[node])
            total += leaf[node - len(feature)]
        return total

    def scores(self, x: np.ndarray, kind: str) -> np.ndarray:
        """Calibrated probabilities."""
        slope, offset = self.curves[kind]
        return 1 / (1 + np.exp(-np.clip(slope * self.margins(x, kind) + offset, -500, 500)))


def calibration(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve that fits labels to margins; labels are smoothed, so that
    the curve is finite where margins separate them."""
    n1 = y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    w = np.array([1.0, 0.0])
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (target - p))
        w = w + np.clip(step, -0.5, 0.5)
    return float(max(w[0], 1e-3)), float(w[1])


def _grow(bins: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, rate: float):
    """A complete tree of ``depth`` levels: at each node the cut of the greatest gain."""
    feature, cut = np.zeros(2**depth - 1, dtype=np.int64), np.zeros(2**depth - 1, dtype=np.int64)
    node = np.zeros(len(bins), dtype=np.int64)
    n_features, n_bins = bins.shape[1], int(bins.max()) + 1 if bins.size else 1
    cells = bins + n_bins * np.arange(n_features)
    for at in range(2**depth - 1):
        rows = np.flatnonzero(node == at)
        best = (0, n_bins)
        if len(rows) and n_bins > 1:
            mine = cells[rows].ravel()
            left_g, left_h = (np.cumsum(np.bincount(mine, np.repeat(v[rows], n_features), n_features * n_bins).reshape(n_features, n_bins), axis=1) for v in (gradient, hessian))
            gain = left_g**2 / (left_h + 1) + (left_g[:, -1:] - left_g) ** 2 / (left_h[:, -1:] - left_h + 1)
            best = np.unravel_index(int(np.argmax(gain[:, :-1])), (n_features, n_bins - 1))
        feature[at], cut[at] = best
        node[rows] = 2 * at + 1 + (bins[rows, best[0]] > best[1])
    leaf = node - (2**depth - 1)
    value = np.bincount(leaf, gradient, 2**depth) / (np.bincount(leaf, hessian, 2**depth) + 1)
    return (feature, cut, rate * value), rate * value[leaf]


def _arrays(snippets):
    x = np.array([features(text, span) for text, span, _ in snippets])
    return x, np.array([label for _, _, label in snippets], dtype=float), np.array([span[0] for _, span, _ in snippets])


def best_first(snippets, scores: np.ndarray) -> np.ndarray:
    """Places of the candidates of one kind that are left when, in each text, the best go first and bar
    those that they overlap."""
    out: list[int] = []
    texts: dict[str, list[int]] = {}
    for i, (text, _, _) in enumerate(snippets):
        texts.setdefault(text, []).append(i)
    for own in texts.values():
        used: list[tuple[int, int]] = []
        for i in sorted(own, key=lambda i: -scores[i]):
            if not _overlaps(used, *snippets[i][1][1:]):
                insort(used, snippets[i][1][1:])
                out.append(i)
    return np.array(out, dtype=np.int64)


def train_detector(snippets, unseen=None, rounds: int = 60, depth: int = 4, rate: float = 0.3, precision: float = PRECISION) -> Detector:
    """Three of four ``snippets`` fit the trees; the others and ``unseen``, by default of the second
    set of forms, calibrate them."""
    x, y, kinds = _arrays(snippets)
    held = np.arange(len(y)) % 4 == 3
    unseen = training_snippets(2500, SEED + 1, forms=1) if unseen is None else unseen
    model = Detector([np.unique(np.quantile(x[~held, f], np.linspace(0.02, 0.98, 31))) for f in range(x.shape[1])], {}, {}, {}, {})
    for kind in KINDS:
        mine = ~held & (kinds == kind)
        bins, wanted = model.binned(x[mine]), y[mine]
        mean = (wanted.sum() + 1) / (len(wanted) + 2)
        model.start[kind], model.trees[kind] = float(np.log(mean / (1 - mean))), []
        total = np.full(len(bins), model.start[kind])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-total))
            tree, step = _grow(bins, wanted - p, p * (1 - p), depth, rate)
            model.trees[kind].append(tree)
            total += step
        test = [r for r, h in zip(snippets, held, strict=True) if h and r[1][0] == kind] + [r for r in unseen if r[1][0] == kind]
        cx, cy, _ = _arrays(test)
        model.curves[kind] = calibration(model.margins(cx, kind), cy)
        scores = model.scores(cx, kind)
        left = best_first(test, scores)
        order = left[np.argsort(-scores[left], kind="stable")]
        right = np.cumsum(cy[order]) / np.arange(1, len(order) + 1)
        # the lowest score that reaches the precision; equal scores are taken together
        last = np.flatnonzero(np.append(scores[order][1:] < scores[order][:-1], True))
        enough = last[right[last] >= precision]
        model.thresholds[kind] = float(scores[order][enough[-1]]) if len(enough) else 2.0
    return model


def added_spans(text: str, base: list[tuple[str, int, int]], model: Detector) -> list[tuple[str, int, int]]:
    """Proposals that the model selects and that overlap no base span of their kind, best first."""
    base_at = {k: sorted((b, e) for kind, b, e in base if kind == k) for k in KINDS}
    free = [s for s in proposals(text) if not _overlaps(base_at[s[0]], s[1], s[2])]
    if not free:
        return []
    x = np.array([features(text, s) for s in free])
    scores = np.empty(len(free))
    for kind in KINDS:
        if mine := [i for i, s in enumerate(free) if s[0] == kind]:
            scores[mine] = model.scores(x[mine], kind)
    out, used = [], {k: list(v) for k, v in base_at.items()}
    for i in np.lexsort(([s[1] for s in free], -scores)):
        kind, begin, end = free[i]
        if scores[i] >= model.thresholds[kind] and not _overlaps(used[kind], begin, end):
            out.append(free[i])
            insort(used[kind], (begin, end))
    return out


def _overlaps(spans: list[tuple[int, int]], begin: int, end: int) -> bool:
    """Whether one of the sorted spans, none of which overlaps another, has a character of [begin, end)."""
    i = bisect_left(spans, (end, -1))
    return i > 0 and spans[i - 1][1] > begin


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = {k: n for n, k in enumerate(KINDS)}
    return ",".join(f"{k}:{b}:{e}" for k, b, e in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


def _find(batches, model: Detector):
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        texts = batch.column("text")
        for at in range(0, len(texts), 256):
            for text in texts.slice(at, 256).to_pylist():
                base = base_spans(text)
                every = base + added_spans(text, base, model)
                for column, kind in zip(out, KINDS, strict=False):
                    column.append(sum(s[0] == kind for s in base))
                out[4].append(joined(base))
                out[5].append(joined(every))
        arrays = [pa.array(c, pa.int64()) for c in out[:4]] + [pa.array(c, pa.string()) for c in out[4:]]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*batch.schema.names[:-1], "n_email", "n_ip", "n_card", "n_phone", "base", "spans"])


def personal_spans(docs: DataFrame, model: Detector | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base, spans.

    The counts and ``base`` are of the base patterns; ``spans`` has the added ones too. Both are
    ``kind:start:end`` by kind, then start, comma-joined, in code points, end exclusive. Null texts
    count as empty and have no span. Null doc_ids and repeated rows stay; no rows give no rows.
    Columns other than doc_id and text are ignored.
    """
    model = model or train_detector(training_snippets())
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(lambda it: _find(it, model), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by ``[kind]``; overlapping spans become one, of the first's kind."""
    out, at = [], 0
    for kind, begin, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if begin >= at:
            out += [text[at:begin], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def op8_personal_data(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = personal_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def digest(base: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(base).encode()).hexdigest()
