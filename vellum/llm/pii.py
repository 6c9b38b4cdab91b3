"""Personal data: spans by fixed patterns, and more spans from candidates that boosted trees accept.

Four kinds have a fixed pattern each; those spans always stand. Beyond them, generators propose
candidates with high recall, overlapping ones as well: addresses with the signs spelled out, numbers in
any grouping, IBANs, social security numbers, IPv6. Each candidate is described by its format and by
what stands around it, gradient-boosted trees score it, and a threshold for each kind, calibrated on
examples that the trees didn't see, selects; of overlapping ones the best scored stands.

The trees learn from examples made by rule: personal data and what is easily taken for it (dates,
amounts, versions, article numbers, hashes, numbers with a wrong check digit), put between words of a
bounded sample of the documents.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.quality_model import Trees, boost

#: Kinds in the order in which spans of one start stand; the first four are those of the fixed patterns.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d *= 1 + k % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern, leftmost first, found from each @ so that no long word is tried at every letter."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of what the fixed patterns find, in order."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = re.sub(r"[^0-9]", "", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---- candidates

_AT = r"(?:\x20?[\[({<]\x20?(?:at|@)\x20?[\])}>]\x20?|\x20at\x20|\x20?@\x20?)"
_DOT = r"(?:\x20?[\[({<]\x20?(?:dot|\.)\x20?[\])}>]\x20?|\x20dot\x20|\.)"
_LABEL = re.compile(_DOT + r"(?=[\w-])")
#: The sign and the domain; the name before is looked for from there.
_SPELLED = re.compile(rf"(?P<at>{_AT})[\w-]{{1,63}}(?:{_DOT}[\w-]{{1,63}}){{1,4}}")
_NAME = re.compile(r"(?:[\w.+-]*[\w+-])?\Z")
_IP6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
_IP4 = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\x20?\.\x20?)[0-9]{1,3}){3}(?![0-9])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Z0-9]{1,4}){3,8}(?![A-Za-z0-9])")
_GROUPS = re.compile(r"[0-9]+")
#: What may lie between the groups of one number.
_JOIN = re.compile(r"[\x20\xa0().\-/–]{1,3}")


def _numbers(text: str) -> Iterator[tuple[int, int, int]]:
    """Runs of neighbouring groups of digits with 7 to 19 digits, each from every group on."""
    groups = [m.span() for m in _GROUPS.finditer(text)]
    joined = [bool(_JOIN.fullmatch(text, a[1], b[0])) if b[0] - a[1] <= 3 else False for a, b in zip(groups, groups[1:])] + [False]
    for i, (start, _) in enumerate(groups):
        if start and text[start - 1].isalnum():
            continue
        digits, j = 0, i
        while True:
            digits += groups[j][1] - groups[j][0]
            if digits > 19:
                break
            if digits >= 7:
                end, began = groups[j][1], start
                if began and text[began - 1] == "(" and ")" in text[start:end]:
                    began -= 1
                if began and text[began - 1] == "+":
                    began -= 1
                if digits >= 12:
                    yield began, 2, end
                if digits <= 15:
                    yield began, 3, end
                if digits == 9 and j == i + 2:
                    yield began, 5, end
            if not joined[j]:
                break
            j += 1


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of all that may be personal data, overlapping ones too."""
    out = []
    if "@" in text or "at" in text:
        for m in _SPELLED.finditer(text):
            name = _NAME.search(text[max(0, m.start() - 64) : m.start()]).group()
            if name:
                # the last labels may be those of a sentence that follows without a space
                dots = [d.start() for d in _LABEL.finditer(text, m.end("at"), m.end())]
                out += [(m.start() - len(name), 0, end) for end in (*dots[1:], m.end())]
    if text.count(":") > 1:
        out += [(m.start(), 1, m.end()) for m in _IP6.finditer(text) if re.search("[0-9A-Fa-f]", m.group())]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP4.finditer(text)]
        out += [(m.start(), 4, m.end()) for m in _IBAN.finditer(text)]
        out += _numbers(text)
    return out


# ---- features

#: Words before a value that tell its kind, and words that tell that it is none.
CUES = (
    {"mail", "email", "contact", "contacto", "kontakt", "write", "schreiben", "correo", "courriel", "adresse", "address"},
    {"ip", "host", "server", "addr", "client", "peer", "login"},
    {"card", "visa", "mastercard", "amex", "credit", "karte", "kreditkarte", "carte", "tarjeta", "cc"},
    {"tel", "phone", "telefon", "téléphone", "teléfono", "call", "fax", "mobile", "mobil", "móvil", "handy", "ring", "cell", "whatsapp"},
    {"iban", "konto", "account", "compte", "cuenta", "bank"},
    {"ssn", "social", "security", "insurance"},
    {"version", "v", "release", "section", "page", "seite", "isbn", "order", "invoice", "no", "nr", "item", "id", "sku", "date", "on", "total", "price", "eur", "usd", "serial", "build", "sha", "commit", "tracking", "article", "row", "since", "from"},
)
#: Last labels of most public addresses.
ENDINGS = {"com", "org", "net", "edu", "gov", "info", "biz", "io", "co", "me", "de", "at", "ch", "fr", "be", "es", "it", "nl", "pt", "uk", "us", "ca", "mx", "ar", "br", "eu", "pl", "se", "dk", "jp", "cn", "in", "au"}
_WORD_BEFORE = re.compile(r"[\w]+")


def _mod97(text: str) -> bool:
    plain = re.sub(r"[\x20-]", "", text)
    if not 15 <= len(plain) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _kind_of(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isdigit() else 2 if c.isalpha() else 3 if c in ".,;!?" else 4 if c in "([{<\"'" else 5 if c in ")]}>" else 6 if c in "$€£%#" else 7


def _beyond(text: str, end: int) -> tuple[float, float]:
    """Whether another label of an address follows, and whether it is one of ENDINGS."""
    label = _LABEL.match(text, end)
    more = _WORD_BEFORE.match(text, label.end()) if label else None
    return float(more is not None), float(more is not None and more.group() in ENDINGS)


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """The format of a candidate and its surroundings, as numbers."""
    s = text[start:end]
    groups = [m.group() for m in _GROUPS.finditer(s)]
    digits = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    letters = sum(c.isalpha() for c in s)
    seps = [c for c in s if not c.isalnum()]
    before = _WORD_BEFORE.findall(text[max(0, start - 40) : start].lower())[-3:]
    after = _WORD_BEFORE.findall(text[end : end + 25].lower())[:1]
    date = len(groups) >= 3 and any(
        1 <= int(a) <= 31 and 1 <= int(b) <= 31 and len(c) in (2, 4) and (len(c) == 2 or 1800 < int(c) < 2200)
        for a, b, c in (groups[:3], groups[2::-1])
        if len(a) <= 2 and len(b) <= 2
    )
    words = re.findall(r"[^\W\d_]+", s)
    return [
        *(float(kind == k) for k in range(len(KINDS))),
        len(s), len(digits), letters, len(seps), len(set(seps)), len(groups), min(sizes), max(sizes), sizes[0], sizes[-1],
        float(bool(digits) and luhn(digits)), float(kind == 4 and _mod97(s)), float(bool(groups) and all(len(g) <= 3 and int(g) <= 255 for g in groups)),
        float(s.startswith("+")), float("(" in s), float("@" in s), s.count("."), s.count("-"), s.count(" "), s.count("/"), s.count(":"), float("  " in s),
        float(bool(re.search(r"[\[({<]", s))), float("at" in s.split() or "dot" in s.split()), len(words[-1]) if words else 0, float(bool(words) and words[-1] in ENDINGS), float(s.endswith((".", "-"))), float(s[-1:].isdigit()), *_beyond(text, end),
        float(int(digits[0])) if digits else -1, len(set(digits)), float(date), float(any(len(g) == 4 and g[:2] in ("19", "20") for g in groups)),
        float(len({a for a in sizes}) == 1), float(len(digits) > 1 and digits[0] == "0"), float(digits[3:6] == "555"),
        _kind_of(text[start - 1 : start]), _kind_of(text[end : end + 1]), float(bool(re.match(r"\.\w", text[end : end + 2]))), float(text[end : end + 2].strip(" .-/(),:")[:1].isdigit()), float(text[max(0, start - 2) : start].strip(" .-/(),:")[-1:].isdigit()),
        *(float(any(w in cue for w in before)) for cue in CUES), *(float(any(w in cue for w in after)) for cue in CUES[-1:]),
    ]


# ---- examples

_TLDS = ("com", "org", "net", "de", "fr", "es", "io", "co.uk", "info")


def _number(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _checked(rng: random.Random, n: int, good: bool) -> str:
    body = rng.choice("3456") + _number(rng, n - 2)
    right = next(d for d in "0123456789" if luhn(body + d))
    return body + (right if good else rng.choice([d for d in "0123456789" if d != right]))


def _name(rng: random.Random) -> str:
    return "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiouéü") for _ in range(rng.randint(1, 4)))


def _grouped(digits: str, sizes: tuple[int, ...], sep: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(digits[at : at + n])
        at += n
    return sep.join(x for x in [*out, digits[at:]] if x)


def _iban(rng: random.Random, good: bool) -> str:
    country, body = rng.choice([("DE", _number(rng, 18)), ("ES", _number(rng, 20)), ("FR", _number(rng, 23)), ("GB", "NWBK" + _number(rng, 14))])
    check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    plain = f"{country}{(check if good else (check + rng.randint(1, 90)) % 97):02d}{body}"
    return _grouped(plain, (4,) * 9, rng.choice(["", " ", " "]))


def positive(rng: random.Random) -> tuple[int, str]:
    """One value of a kind, in one of the ways in which people write it."""
    kind = rng.randrange(len(KINDS))
    if kind == 0:
        at, dot = rng.choice([("@", "."), ("@", "."), (" at ", " dot "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "."), (" @ ", "."), (" at ", "."), ("(at)", "(dot)")])
        domain = rng.choice([_name(rng), f"mail{rng.randint(1, 9)}.{_name(rng)}"]) + "." + rng.choice(_TLDS)
        return 0, rng.choice([_name(rng), f"{_name(rng)}.{_name(rng)}", f"{_name(rng)}{rng.randint(1, 99)}"]) + at + domain.replace(".", dot)
    if kind == 1:
        if rng.random() < 0.4:
            return 1, ":".join(f"{rng.randrange(65536):x}" for _ in range(8)) if rng.random() < 0.6 else f"2001:db8::{rng.randrange(65536):x}:{rng.randrange(65536):x}"
        return 1, rng.choice([".", "[.]", "(.)", "[dot]", " . "]).join(str(rng.randrange(256)) for _ in range(4))
    if kind == 2:
        n = rng.choice([16, 16, 16, 15, 14])
        return 2, _grouped(_checked(rng, n, True), (4, 6, 5) if n == 15 else (4, 4, 4, 4), rng.choice(["", " ", "-", ".", "  ", " - ", "/"]))
    if kind == 3:
        a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
        area = str(rng.randint(30, 9999))
        return 3, rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"1-{a}-{b}-{c}", f"+1 ({a}) {b}-{c}", f"+49 {area} {_number(rng, 6)}",
                              f"0{area}/{_number(rng, 6)}", f"0{area} {_number(rng, 6)}", f"0{rng.randint(1, 9)} " + " ".join(_number(rng, 2) for _ in range(4)), f"00{rng.randint(31, 49)} {area} {_number(rng, 6)}", f"({a}) {b} {c}", f"({a}) 555-{c}"])
    if kind == 4:
        return 4, _iban(rng, True)
    return 5, f"{rng.randint(100, 899):03d}{(s := rng.choice('- '))}{rng.randint(1, 99):02d}{s}{rng.randint(1, 9999):04d}"


def negative(rng: random.Random) -> str:
    """Something that generators may propose and that is no personal data."""
    day, month, year = f"{rng.randint(1, 28):02d}", f"{rng.randint(1, 12):02d}", str(rng.randint(1950, 2030))
    return rng.choice([
        f"{day}.{month}.{year}", f"{year}-{month}-{day}", f"{month}/{day}/{year}", f"{year}-{month}-{day} {rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:{rng.randint(0, 59):02d}", f"{year}{month}{day}",
        f"{rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:{rng.randint(0, 59):02d}", f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(300, 900)}.{rng.randint(0, 9999)}", f"{rng.randint(1, 999)},{_number(rng, 3)},{_number(rng, 3)}.{_number(rng, 2)}",
        f"{rng.randint(1, 999)} {_number(rng, 3)} {_number(rng, 3)}", f"{year}-{rng.randint(1950, 2030)}", f"978-{rng.randint(0, 9)}-{_number(rng, 4)}-{_number(rng, 4)}-{rng.randint(0, 9)}", _checked(rng, 16, False),
        _grouped(_checked(rng, 16, False), (4, 4, 4, 4), rng.choice([" ", "-"])), _number(rng, rng.choice([7, 8, 9, 10, 11, 12, 13, 17, 18])), f"{_number(rng, 5)}-{_number(rng, 5)}-{_number(rng, 5)}",
        "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40]))), f"3.{_number(rng, 12)}", f"{_number(rng, 1)}.{_number(rng, 7)}", f"{rng.randint(1, 99)} {rng.randint(1, 99)} {rng.randint(1, 99)} {rng.randint(1, 99)} {rng.randint(1, 99)}",
        f"{rng.randint(1, 30)}.{rng.randint(1, 30)}.{rng.randint(1, 30)}", f"{_name(rng)} at {_name(rng)}.", f"{_name(rng)} @ {_name(rng)}.{_name(rng).capitalize()}", f"{_name(rng)} at {_name(rng)}. {_name(rng).capitalize()}", f"@{_name(rng)}", f"{_name(rng)}@{_name(rng)}", f"{_name(rng)}::{_name(rng)}", f"a:{_number(rng, 2)}:b", f"std::{_name(rng)}::be",
        _iban(rng, False), f"{rng.choice(['AB', 'XK', 'PO'])}{_number(rng, 2)} {_number(rng, 4)} {_number(rng, 4)} {_number(rng, 4)}", f"{rng.randint(1, 9)}-{rng.randint(10, 99)}-{_number(rng, 6)}", f"{_number(rng, 3)}-{_number(rng, 3)}-{_number(rng, 3)}", f"{_number(rng, 4)}/{_number(rng, 4)}",
        f"{_number(rng, 8)}-{_number(rng, 4)}-4{_number(rng, 3)}-{_number(rng, 4)}-{_number(rng, 12)}",
    ])


def examples(contexts: list[str], count: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, kinds) of the candidates in ``count`` values placed between words of ``contexts``.

    A candidate is right if it is the whole value in its kind. Candidates inside a value are wrong, so
    the trees learn where values end.
    """
    rng = random.Random(seed)
    x, y, kinds = [], [], []
    for _ in range(count):
        # some small numbers among the words, as in lists and tables
        words = [w if rng.random() < 0.9 else str(rng.randrange(100)) for w in (rng.choice(contexts).split() if contexts else [])]
        cut = rng.randint(0, len(words))
        before, after = " ".join(words[:cut]), " ".join(words[cut:])
        kind, value = positive(rng) if rng.random() < 0.5 else (-1, negative(rng))
        cue = rng.choice(sorted(CUES[kind])) if rng.random() < 0.4 else ""
        left = " ".join(p for p in (before, cue) if p) + (rng.choice([": ", " "]) if cue else rng.choice([" ", " ", " ", "\n", " (", ". ", "$ " if kind < 0 else " "]))
        right = rng.choice([" ", " ", " ", ". ", ", ", ".\n", ")", "\n", "!! ", "### ", "%%% "]) + after
        text = left + value + right
        start, end = len(left), len(left) + len(value)
        base = [(s, e) for s, k, e in base_spans(text)]
        for s, k, e in candidates(text):
            # the fixed patterns need no trees, but a value that they find is an example of its kind all the same
            if s < end and e > start and ((k, s, e) == (kind, start, end) or (s, e) not in base):
                x.append(features(text, s, k, e))
                y.append(float((k, s, e) == (kind, start, end)))
                kinds.append(k)
    return np.array(x, float).reshape(len(y), -1), np.array(y), np.array(kinds, int)


@dataclass
class Model:
    trees: Trees
    thresholds: list[float]  # one a kind; 2 where nothing may be added


def thresholds(score: np.ndarray, y: np.ndarray, kinds: np.ndarray, precision: float) -> list[float]:
    """For each kind the least score, a half or more, from which on at least ``precision`` of the candidates are right.

    One wrong candidate is taken for granted, so a kind with few examples has to do without.
    """
    out = []
    for k in range(len(KINDS)):
        own = np.flatnonzero((kinds == k) & (score >= 0.5))
        own = own[np.argsort(-score[own], kind="stable")]
        good = np.cumsum(y[own]) / (np.arange(len(own)) + 2)
        enough = np.flatnonzero(good >= precision)
        out.append(float(score[own[enough[-1]]]) if len(enough) else 2.0)
    return out


def contexts_of(docs: DataFrame, most: int, words: int = 24) -> list[str]:
    """Words of at most ``most`` different texts, those first by their hash: ``words`` from the middle of each.

    Only hashes under a bound that lets some four times ``most`` rows through are looked at, so what is
    sorted doesn't grow with the table.
    """
    told = docs.where("text IS NOT NULL").withColumn("h", F.xxhash64("text"))
    bound = min(1.0, 4 * most / max(1, docs.count()))
    some = told.where(F.pmod("h", F.lit(1 << 30)) < int(bound * (1 << 30)))
    found = F.split(F.col("text"), r"[\x20\x09-\x0D]+")
    middle = F.slice(found, F.greatest(F.lit(1), (F.size(found) / 2).cast("int") - words // 2), words)
    rows = some.select("h", F.substring(F.concat_ws(" ", middle), 1, 1000).alias("words")).groupBy("h").agg(F.min("words").alias("words"))
    return [r["words"] for r in rows.orderBy("h").limit(most).collect()]


def learn(docs: DataFrame, most: int = 2000, count: int = 10_000, precision: float = 0.98, seed: int = 11) -> Model:
    """Trees from ``count`` examples between words of at most ``most`` documents, and thresholds from half as many others."""
    contexts = contexts_of(docs, most)
    x, y, _ = examples(contexts, count, seed)
    trees = boost(x, y, trees=80, depth=5)
    x, y, kinds = examples(contexts, count // 2, seed + 1)
    return Model(trees, thresholds(trees.score(x), y, kinds, precision))


def added_spans(text: str, base: list[tuple[int, int, int]], scored: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans to add, best scored first, none across a span that stands; ties go to the first start, then the longest."""
    taken = sorted((s, e) for s, _, e in base)
    out: list[tuple[int, int, int]] = []
    for _, start, kind, end in sorted(scored, key=lambda c: (-c[0], c[1], c[1] - c[3], c[2])):
        if all(e <= start or s >= end for s, e in taken):
            taken.append((start, end))
            out.append((start, kind, end))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find(docs: DataFrame, model: Model | None = None, at_once: int = 4096) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (spans of the fixed patterns) and spans (all) of every row.

    Spans are kind:start:end in code points, by start and kind, joined by commas. A null text counts as
    an empty one: no spans. Texts are read whole; one has to fit into a task. Rows are kept one for one,
    repeated ones and null doc_ids too; of ``docs`` only doc_id and text are read. Without a ``model``
    one is learned from ``docs``. Candidates are scored ``at_once`` or more at a time.
    """
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs) if model is None else model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        least = np.array(model.thresholds)

        def done(ids: list, rows: list, found: list, x: list) -> pa.RecordBatch:
            by_row: dict[int, list] = {}
            if x:
                score = model.trees.score(np.array(x, float))
                kinds = np.array([c[2] for c in found])
                for i in np.flatnonzero(score >= least[kinds]):
                    row, start, k, end = found[i]
                    by_row.setdefault(row, []).append((float(score[i]), start, k, end))
            spans = [joined(base + added_spans("", base, by_row[i])) if i in by_row else joined(base) for i, base in enumerate(rows)]
            counts = [pa.array([sum(k == n for _, k, _ in base) for base in rows], pa.int64()) for n in range(len(BASE))]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *counts, pa.array([joined(b) for b in rows], pa.string()), pa.array(spans, pa.string())], names=names)

        for batch in batches:
            ids, rows, found, x, since = [], [], [], [], 0
            for i, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                base = base_spans(text)
                standing = {(s, e) for s, _, e in base}
                for s, k, e in candidates(text):
                    if (s, e) not in standing:
                        found.append((len(rows), s, k, e))
                        x.append(features(text, s, k, e))
                rows.append(base)
                if len(x) >= at_once:
                    yield done([batch.column(0).slice(since, i + 1 - since)], rows, found, x)
                    rows, found, x, since = [], [], [], i + 1
            if rows:
                yield done([batch.column(0).slice(since)], rows, found, x)

    return docs.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in BASE) + ", base string, spans string")


def digests(found: DataFrame) -> DataFrame:
    """The counts of the fixed patterns, the SHA-256 of their spans, and all spans."""
    return found.select("doc_id", *(f"n_{k}" for k in BASE), F.sha2("base", 256).alias("base_sha256"), "spans")


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id and redacted: each text with its spans replaced by the kind in brackets; of overlapping spans the first stands.

    ``found`` is what ``find`` returns for ``docs``; rows meet by doc_id, which has to be unique. A null
    text stays null.
    """
    known = found.select(F.col("doc_id").alias("_found_id"), "spans")
    rows = docs.select("doc_id", "text").join(known, F.col("doc_id").eqNullSafe(F.col("_found_id"))).select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                pieces, at = [], 0
                for span in spans.split(",") if spans else []:
                    name, start, end = span.split(":")
                    if int(start) >= at:
                        pieces += [text[at : int(start)], f"[{name}]"]
                        at = int(end)
                out.append(None if text is None else "".join([*pieces, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "redacted"])

    return rows.mapInArrow(run, f"doc_id {kind}, redacted string")
