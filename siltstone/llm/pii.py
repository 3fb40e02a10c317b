"""Personal data: base patterns, and a semi-Markov conditional random field that adds what they miss.

Base spans (email, ip, card, phone) follow fixed patterns, leftmost and not overlapping per kind, over whole texts. The field
then looks at the neighbourhood of every digit and at-sign: candidate segments of up to LONGEST tokens get scores from
features of the whole span (digit and letter counts, shape, separators, Luhn, value ranges, known prefixes, the words
before), single tokens outside an entity get their own, and a dynamic program over segment ends, labels and label
transitions picks boundaries and types jointly. Its segments that don't touch a base span are added. A label's segments are
limited by length and character class alone. A neighbourhood ends at white space, so no token is cut, and a run of the characters
of keys is a candidate whole, whatever its length; other entities of over LONGEST tokens are none (an address in words may be).

Weights are learned by stochastic gradient on the conditional log-likelihood (forward-backward over segments), on SENTENCES
made-up sentences from a fixed seed, as no table has labels for personal data: local phone numbers, spaced or bracketed
e-mail addresses, IPv6, access keys of 16 to 200 characters, social security numbers and IBANs among look-alikes (years, dates, versions, prices,
order numbers, card-like numbers that fail Luhn) that must stay. Training is cached for the life of the driver.

Defined results: null and empty texts have no spans and stay as they are; text of any length is read whole, in linear time and
with candidates held for STEP tokens at a time; rows that repeat are treated alike; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone", "secret", "ssn", "iban"]
BASE_KINDS = KINDS[:4]
LONGEST, AROUND, SENTENCES, EPOCHS, SEED = 16, 60, 900, 6, 11
#: Tokens whose candidates are held at a time.
STEP = 512

Span = tuple[str, int, int]

# Possessive repeats and the look-behind match what the plain patterns match, without trying every start of a long run.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d *= 1 + k % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield start, free
        else:
            free = max(free, at + 1)
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """By start, then kind."""
    out: list[Span] = [("email", *x) for x in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0")[:4] or 0) <= 255 for x in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append(("phone", *m.span()))
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


# ---- the field -------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_GAP = re.compile(r"\s")
_TRIGGER = re.compile(r"[0-9]+|@|[\[(]at[\])]")
_AT = re.compile(r"@|[\[(]\s*at\s*[\])]")
#: Words that may announce an entity.
CUES = {"email": ["mail", "contact"], "ip": ["host", "ip"], "card": ["card", "visa"], "phone": ["call", "tel", "phone"], "secret": ["key", "token", "secret"], "ssn": ["ssn", "social"], "iban": ["iban", "account"]}
#: For each label the characters that its segments consist of, and how many there are.
LIMITS = [
    (1, re.compile(r"[^\s,;:<>\"']{6,}|[^,;:<>\"'\n]{6,120}")), (2, re.compile("[0-9A-Fa-f.:]{7,45}")), (3, re.compile("[0-9 -]{12,37}")), (4, re.compile("[0-9 +().-]{7,30}")),
    (5, re.compile("[A-Za-z0-9_-]{16,}")), (6, re.compile("[0-9 -]{9,11}")), (7, re.compile("[A-Z0-9 ]{15,44}")),
]
_KEY_RUN = re.compile("[A-Za-z0-9_-]+")
_CUE_WORDS = {w for x in CUES.values() for w in x} | {"order", "page", "version", "license", "total"}
Token = tuple[int, int]


def bucket(n: int, edges: tuple[int, ...]) -> int:
    return sum(n >= e for e in edges)


def shape(text: str, lengths: bool) -> str:
    out = re.sub(r"\d+", lambda m: f"9{min(len(m[0]), 20)}" if lengths else "9", text)
    return re.sub(r"[A-Z]+", "A", re.sub(r"[^\W\d_A-Z]+", "a", out))[:40]


def before(text: str, at: int) -> list[str]:
    """Of the two words before, those that CUES has."""
    return [w for x in text[max(0, at - 30) : at].split()[-2:] if (w := x.lower().strip(".,:;()=\"'")) in _CUE_WORDS]


def admissible(own: str) -> list[int]:
    """Labels that a segment can have at all, by its length and characters alone; an address has a mark for "at" besides."""
    return [label for label, limit in LIMITS if limit.fullmatch(own) and (label != 1 or _AT.search(own))]


def span_features(text: str, tokens: list[Token], i: int, j: int) -> list[str]:
    """Features of the segment of tokens i to j - 1 as a whole."""
    start, end = tokens[i][0], tokens[j - 1][1]
    own = text[start:end]
    digits = [c for c in own if c.isdigit()]
    groups = re.findall(r"\d+", own)
    letters = sum(c.isalpha() for c in own)
    last, next_ = text[start - 1 : start], text[end : end + 1]
    out = [
        "bias", f"digits {bucket(len(digits), (1, 4, 7, 9, 10, 11, 12, 13, 15, 16, 17, 20))}", f"letters {bucket(letters, (1, 2, 3, 5, 9, 15, 20))}", f"shape {shape(own, True)}", f"kind {shape(own, False)}",
        f"marks {''.join(sorted(set(re.findall(r'[^A-Za-z0-9]', own))))[:12]}", f"tokens {bucket(j - i, (2, 3, 5, 7, 9, 12))}", f"groups {min(len(groups), 9)}",
        f"run {bool(_KEY_RUN.match(last))} {bool(_KEY_RUN.match(next_))}", f"cut {last.isalnum() or last in ('_', '+', '@') and bool(last)} {next_.isalnum() or next_ in ('_', '@') and bool(next_)}", f"longer {bool(re.match(r'[.-]?[0-9]', text[end : end + 2]))} {bool(re.search(r'[0-9][ .-]?$', text[max(0, start - 2) : start]))}",
    ]
    if 12 <= len(digits) <= 19 and not letters:
        out.append(f"luhn {luhn(''.join(digits))}")
    if len(groups) == 4 and own.count(".") == 3:
        out.append(f"quad {all(int(g[:4]) <= 255 for g in groups)}")
    if re.fullmatch(r"[0-9A-Fa-f:]+", own) and own.count(":") >= 2:
        out.append(f"colons {own.count(':')} {max(map(len, own.split(':'))) <= 4} {'::' in own}")
    if _AT.search(own):
        out.append(f"at {bool(re.search(r'(?:[.]|[(\[]\s*dot\s*[)\]])\s*[a-z]{2,}$', own))}")
    if re.fullmatch(r"[A-Za-z0-9_-]+", own):
        out.append(f"key {bool(re.match('AKIA|ghp_|sk-|xox', own))} {own.upper() == own} {bucket(len(own), (8, 16, 20, 24, 36))}")
    if re.match(r"[A-Z]{2}\d\d", own):
        out.append(f"country {bucket(len(own.replace(' ', '')), (12, 15, 18, 22, 27))}")
    out += [f"word {w}" for w in before(text, start)]
    return out


def outer_features(text: str, token: Token) -> list[str]:
    own = text[token[0] : token[1]]
    return ["bias", f"shape {shape(own, True)}" if own[0].isdigit() else f"outer {shape(own, False)}", *(f"word {w}" for w in before(text, token[0])[-1:])]


def segments(text: str, tokens: list[Token], first: int = 0, last: int | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Candidate entities that begin at tokens first to last - 1, within one line and with one space at most between tokens; 0 for each label they can have.

    They have LONGEST tokens at most; what keys consist of is also one candidate from end to end, however long it is.
    """
    out, masks = [], []
    end_at = {b: j for j, (_, b) in enumerate(tokens, 1)}
    for i in range(first, len(tokens) if last is None else last):
        start = tokens[i][0]
        head = text[start]
        if not (head.isalnum() or head in "+(:"):
            continue
        for j in range(i + 1, min(i + LONGEST, len(tokens)) + 1):
            low, high = tokens[j - 1]
            if j > i + 1 and (low - tokens[j - 2][1] > 1 or text[low - 1] == "\n"):
                break
            if text[high - 1].isalnum() and (labels := admissible(text[start:high])):
                out.append((i, j))
                masks.append(np.full(len(KINDS) + 1, -np.inf))
                masks[-1][labels] = 0
        run = None if start and _KEY_RUN.match(text[start - 1]) else _KEY_RUN.match(text, start)
        j = end_at.get(run.end(), 0) if run else 0
        if j > i + LONGEST and (labels := admissible(run[0])):
            out.append((i, j))
            masks.append(np.full(len(KINDS) + 1, -np.inf))
            masks[-1][labels] = 0
    return out, np.array(masks).reshape(-1, len(KINDS) + 1)


@dataclass
class Field:
    names: dict[str, int]
    weights: np.ndarray  # features x labels; label 0: outside
    moves: np.ndarray  # labels x labels

    def scores(self, features: list[list[str]]) -> np.ndarray:
        names = self.names
        return np.array([self.weights[[names[f] for f in x if f in names]].sum(0) for x in features]).reshape(-1, len(KINDS) + 1)

    def decode(self, text: str, low: int = 0, high: int | None = None, step: int = STEP) -> list[Span]:
        """The entities of the likeliest segmentation of text[low:high], an edge of which cuts no token; features see the whole text.

        Candidates and their features are made for `step` tokens at a time; of the others only best scores and the way back are held.
        """
        tokens = [m.span() for m in _TOKEN.finditer(text, low, len(text) if high is None else high)]
        n, labels = len(tokens), len(KINDS) + 1
        best = np.full((n + 1, labels), -np.inf)
        back, back_label = np.zeros((n + 1, labels), np.int32), np.zeros((n + 1, labels), np.int8)
        best[0, 0] = 0
        for first in range(0, n, step):
            last = min(first + step, n)
            spans, mask = segments(text, tokens, first, last)
            if not spans and n <= step:
                return []
            inner, outer = mask + self.scores([span_features(text, tokens, i, j) for i, j in spans]), self.scores([outer_features(text, t) for t in tokens[first:last]])
            starts: dict[int, list[int]] = {}
            for k, (i, _) in enumerate(spans):
                starts.setdefault(i, []).append(k)
            for i in range(first, last):
                arrive = best[i][:, None] + self.moves
                come, value = arrive.argmax(0), arrive.max(0)
                if value[0] + outer[i - first, 0] > best[i + 1, 0]:
                    best[i + 1, 0], back[i + 1, 0], back_label[i + 1, 0] = value[0] + outer[i - first, 0], i, come[0]
                for k in starts.get(i, ()):
                    j, total = spans[k][1], value + inner[k]
                    for y in np.flatnonzero(total[1:] > best[j, 1:]) + 1:
                        best[j, y], back[j, y], back_label[j, y] = total[y], i, come[y]
        follows = high is not None and _TOKEN.search(text, high)  # the next token is outside
        out, at, y = [], n, int((best[-1] + self.moves[:, 0] if follows else best[-1]).argmax())
        while at:
            i, from_ = int(back[at, y]), int(back_label[at, y])
            if y:
                out.append((KINDS[y - 1], tokens[i][0], tokens[at - 1][1]))
            at, y = i, from_
        return out[::-1]


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.maximum(x.max(axis, keepdims=True), -1e300)
    with np.errstate(divide="ignore"):
        return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


@lru_cache(maxsize=2)
def trained(sentences: int = SENTENCES, epochs: int = EPOCHS, seed: int = SEED) -> Field:
    """Stochastic gradient (AdaGrad) on the conditional log-likelihood of segmentations."""
    rng = np.random.default_rng(seed)
    names: dict[str, int] = {}
    labels, data = len(KINDS) + 1, []
    for text, gold in (example(rng) for _ in range(sentences)):
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        spans, mask = segments(text, tokens)
        place = {(tokens[i][0], tokens[j - 1][1]): k for k, (i, j) in enumerate(spans)}
        if any((a, b) not in place for _, a, b in gold):
            continue
        inner = [np.array([names.setdefault(f, len(names)) for f in span_features(text, tokens, i, j)]) for i, j in spans]
        outer = [np.array([names.setdefault(f, len(names)) for f in outer_features(text, t)]) for t in tokens]
        data.append((tokens, spans, mask, inner, outer, {place[a, b]: KINDS.index(kind) + 1 for kind, a, b in gold}))
    weights, moves = np.zeros((len(names), labels)), np.zeros((labels, labels))
    seen, seen_moves = np.full(weights.shape, 1e-2), np.full(moves.shape, 1e-2)
    for _ in range(epochs):
        for at in rng.permutation(len(data)):
            tokens, spans, mask, inner, outer, gold = data[at]
            n = len(tokens)
            into = mask + np.array([weights[f].sum(0) for f in inner]).reshape(-1, labels)
            out = np.array([weights[f].sum(0)[0] for f in outer])
            ahead, behind = np.full((n + 1, labels), -np.inf), np.full((n + 1, labels), -np.inf)
            ahead[0, 0], behind[n] = 0, 0
            by_start: list[list[int]] = [[] for _ in range(n)]
            by_end: list[list[int]] = [[] for _ in range(n + 1)]
            for k, (i, j) in enumerate(spans):
                by_start[i].append(k)
                by_end[j].append(k)
            arrive = np.full((n, labels), -np.inf)
            for j in range(n + 1):
                if j:
                    ahead[j, 0] = arrive[j - 1, 0] + out[j - 1]
                    if own := by_end[j]:
                        ahead[j, 1:] = log_sum(np.array([arrive[spans[k][0], 1:] + into[k, 1:] for k in own]), 0)
                if j < n:
                    arrive[j] = log_sum(ahead[j][:, None] + moves, 0)
            leave = np.full((n, labels), -np.inf)
            for i in range(n - 1, -1, -1):
                leave[i, 0] = out[i] + behind[i + 1, 0]
                if own := by_start[i]:
                    leave[i, 1:] = log_sum(np.array([into[k, 1:] + behind[spans[k][1], 1:] for k in own]), 0)
                behind[i] = log_sum(moves + leave[i][None, :], 1)
            whole = log_sum(ahead[n], 0)
            rate = 0.3
            grad: dict[int, np.ndarray] = {}
            covered = {t for k in gold for t in range(*spans[k])}
            for k, f in enumerate(inner):
                i, j = spans[k]
                p = np.exp(arrive[i] + into[k] + behind[j] - whole)
                p[0] = 0
                if k in gold:
                    p[gold[k]] -= 1
                if np.abs(p).max() > 1e-4:
                    for x in f.tolist():
                        grad[x] = grad.get(x, 0) + p
            for t, f in enumerate(outer):
                p = np.zeros(labels)
                p[0] = np.exp(arrive[t, 0] + out[t] + behind[t + 1, 0] - whole) - (t not in covered)
                for x in f.tolist():
                    grad[x] = grad.get(x, 0) + p
            step = np.exp(ahead[:n, :, None] + moves[None] + leave[:, None, :] - whole).sum(0)
            y, t, ends = 0, 0, {spans[k][0]: (spans[k][1], v) for k, v in gold.items()}
            while t < n:
                j, v = ends.get(t, (t + 1, 0))
                step[y, v] -= 1
                t, y = j, v
            rows = np.fromiter(grad, int)
            g = np.array([grad[x] for x in rows.tolist()]) + 1e-4 * weights[rows]
            seen[rows] += g**2
            weights[rows] -= rate * g / np.sqrt(seen[rows])
            seen_moves += step**2
            moves -= rate * step / np.sqrt(seen_moves)
    return Field(names, weights, moves)


# ---- made-up sentences -----------------------------------------------------------------------------------------------

_FILL = "the and of in is on a to that with report meeting note list data from by for at was thing paper order total page version build section le la de und der die el los que".split()


def example(rng: np.random.Generator) -> tuple[str, list[Span]]:
    """A sentence with entities and look-alikes, and its gold spans."""
    pick = lambda x: x[int(rng.integers(len(x)))]
    digits = lambda n: "".join(str(rng.integers(10)) for _ in range(n))
    word = lambda: "".join(pick(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "ou"]) for _ in range(int(rng.integers(1, 4))))
    upper = lambda n: "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))

    def card(valid: bool) -> str:
        body = pick(["4", "5", "37", "6011"])
        body += digits((15 if body != "37" else 14) - len(body))
        check = next(c for c in "0123456789" if luhn(body + c))
        body += check if valid else str((int(check) + 1 + int(rng.integers(8))) % 10)
        sep = pick(["", " ", "-"])
        return sep.join(body[k : k + 4] for k in range(0, len(body), 4))

    def phone() -> str:
        area, a, b = str(rng.integers(200, 999)), digits(3), digits(4)
        return pick([f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"{area}.{a}.{b}", f"{area} {a} {b}", f"+1 ({area}) {a}-{b}", f"+1-{area}-{a}-{b}", f"+44 {digits(4)} {digits(6)}", f"0{digits(3)} {digits(7)}"])

    def email() -> str:
        name, host, tld = pick([word() + digits(2), f"{word()}.{word()}", word()]), word(), pick(["com", "org", "net", "de", "fr", "example"])
        return pick([f"{name}@{host}.{tld}", f"{name} (at) {host} (dot) {tld}", f"{name} [at] {host} [dot] {tld}", f"{name} @ {host}.{tld}"])

    def long_key() -> str:
        """Mixed letters with few or many digits, and some with marks in between."""
        letters = pick(["abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"])
        own = [pick(letters) for _ in range(int(pick([18, 24, 32, 40, 64, 100, 200, 400]) + rng.integers(9)))]
        share, marks = pick([0.0, 0.03, 0.1, 0.3]), pick([0.0, 0.0, 0.03, 0.1])
        for k in range(1, len(own) - 1):
            own[k] = digits(1) if rng.random() < share else pick("-_") if rng.random() < marks else own[k]
        own[int(rng.integers(len(own)))] = digits(1)
        return pick(["", "", "", "ghp_", "sk-"]) + "".join(own)

    entity = {
        "email": email,
        "ip": lambda: pick([".".join(str(rng.integers(256)) for _ in range(4)), ":".join(f"{int(rng.integers(65536)):x}" for _ in range(8)), f"2001:db8::{int(rng.integers(65536)):x}"]),
        "card": lambda: card(True),
        "phone": phone,
        "secret": lambda: pick([f"AKIA{upper(16)}", f"ghp_{''.join(pick('abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789') for _ in range(36))}", "".join(pick("0123456789ABCDEF") for _ in range(40)), "".join(pick("0123456789abcdef") for _ in range(40)), long_key(), long_key(), long_key()]),
        "ssn": lambda: f"{rng.integers(100, 899)}-{rng.integers(10, 99)}-{digits(4)}",
        "iban": lambda: (lambda x: pick([x, " ".join(x[k : k + 4] for k in range(0, len(x), 4))]))(pick([pick(["DE", "FR", "ES"]) + digits(pick([20, 18, 22])), f"{pick(['GB', 'NL'])}{digits(2)}{''.join(pick('ABCDEFGHIJKLMNOPQRSTUVWXYZ') for _ in range(4))}{digits(14)}"])),
    }
    alike = [
        lambda: str(rng.integers(1, 300)), lambda: str(rng.integers(1900, 2030)), lambda: f"{rng.integers(2000, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", lambda: f"{rng.integers(1, 9)}.{rng.integers(0, 20)}", lambda: f"v{rng.integers(1, 9)}.{rng.integers(0, 20)}.{rng.integers(0, 20)}",
        lambda: f"${rng.integers(1, 999)}.{digits(2)}", lambda: f"{rng.integers(1, 24)}:{digits(2)}", lambda: card(False), lambda: digits(int(rng.integers(5, 22))), lambda: f"{rng.integers(256, 999)}.{rng.integers(256)}.{rng.integers(256)}.{rng.integers(256, 999)}", lambda: f"{rng.integers(1, 99)}/{rng.integers(1, 99)}/{rng.integers(1900, 2030)}",
        lambda: f"{word()}{rng.integers(1, 99)}", lambda: f"{rng.integers(1, 99)}%", lambda: f"@{word()}", lambda: f"{rng.integers(1, 999)},{digits(3)}", lambda: f"CC BY-NC {rng.integers(1, 5)}.0", lambda: f"License {rng.integers(1, 4)}", lambda: f"{word()} at {word()} {rng.integers(1, 9)}", lambda: f"{digits(3)}*** {digits(2)}&&&", lambda: f"{digits(2)} | {digits(3)} | {digits(2)}",
        lambda: f"ISO-{rng.integers(100, 9999)}", lambda: f"{upper(3)}-{digits(4)}", lambda: f"{digits(4)}-{digits(4)}", lambda: f"{word()}-{word()}-{word()}-{digits(1)}", lambda: f"{word()}_{word()}_{word()}{digits(2)}", lambda: f"{word()}{word()}{word()}{word()}{digits(2)}", lambda: f"{digits(4)}-{word()}-{word()}-{word()}",
        lambda: f"{word()}-{digits(4)}-{word()}-{word()}-{digits(1)}", lambda: f"97{pick('89')}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", lambda: f"97{pick('89')}{digits(10)}",
    ]
    text, gold = "", []
    for _ in range(int(rng.integers(2, 5))):
        text += "".join(pick([pick(_FILL), word(), word()]) + pick([" ", " ", " ", ", ", ". "]) for _ in range(int(rng.integers(0, 4))))
        if rng.random() < 0.5:
            kind = pick(KINDS)
            text += pick([pick(CUES[kind]) + pick([" ", ": "]), "", ""])
            own = entity[kind]()
            gold.append((kind, len(text), len(text) + len(own)))
        else:
            own = pick(alike)()
        text += own + pick([" ", ". ", ", ", "; ", "\n"])
    return text + word(), gold


# ---- over texts ------------------------------------------------------------------------------------------------------


def neighbourhoods(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of AROUND characters and more around digits and at-signs, in order, not overlapping, from white space to white space however far."""
    low = high = -1
    for m in _TRIGGER.finditer(text):
        if m.end() + AROUND <= high:
            continue
        a = max(0, m.start() - AROUND)
        if a > high and (high < 0 or _TOKEN.search(text, high, a)):
            if high > 0:
                yield low, high
            least = max(high, 0)
            while a > least and not text[a - 1].isspace():
                a -= 1
            low = a
        gap = _GAP.search(text, min(len(text), m.end() + AROUND))
        high = gap.start() if gap else len(text)
    if high > 0:
        yield low, high


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans; base and added ones."""
    base = base_spans(text)
    added = [span for low, high in neighbourhoods(text) for span in field.decode(text, low, high)]
    return base, sorted(base + apart(added, base), key=lambda s: (s[1], KINDS.index(s[0])))


def apart(added: list[Span], base: list[Span]) -> list[Span]:
    """Of added spans those that touch no base span; both ascend by start."""
    out, k, reach = [], 0, 0
    for span in added:
        while k < len(base) and base[k][1] < span[2]:
            reach = max(reach, base[k][2])
            k += 1
        if reach <= span[1]:
            out.append(span)
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, and as kind:start:end strings joined by commas (code points, end exclusive): base, spans (base and added)."""
    field = field or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [all_spans(x.as_py() or "", field) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([joined(r[k]) for r in rows], pa.string()) for k in (0, 1))], ["doc_id", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, base string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """Each stretch of spans becomes [KIND] of its first one."""
    out, free = [], 0
    for kind, a, b in spans:
        if a >= free:
            out += [text[free:a], f"[{kind.upper()}]"]
        free = max(free, b)
    return "".join([*out, text[free:]])


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with its text masked; other columns as they are, and null texts too."""
    field, names = field or trained(), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            texts = [x if x is None else masked(x, all_spans(x, field)[1]) for x in (v.as_py() for v in batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns)], names)

    return docs.mapInArrow(run, docs.schema)
