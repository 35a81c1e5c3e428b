"""Personal data: candidate generators, boosted trees, calibrated thresholds.

Base spans are found by fixed patterns and always stay. High-recall generators propose further,
possibly overlapping spans (obfuscated e-mail addresses, telephone numbers without a country code,
card numbers with other separators, addresses with a port or in brackets); a boosted model with
features of format and context rates each; every kind has a calibration and a threshold for its
precision of its own, and candidates above it join, best first, where they overlap nothing that is
already taken. Overlaps are found in sorted spans, so the work grows with the text. The model is trained on a
bounded number of composed examples (``EXAMPLES`` of each kind and class), never on the corpus.

Defined cases: a null text is empty and has no spans; positions are code points; rows with null or
repeated ``doc_id`` are documents of their own; an empty table gives an empty result. Every pattern
is linear in the text, also for texts of one long run of digits or letters. Further columns are
left alone.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepgrid.llm.boost import Calibrated
from sweepgrid.llm.shared import table
from sweepgrid.llm.words import slices

KINDS = ("email", "ip", "card", "phone")
EXAMPLES = 1500
PRECISION = 0.98

# Possessive runs and the look-behind only keep a failing run of digits from being tried again at
# each of its places; they find what the plain patterns find.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain.domain, found from each ``@`` outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if 13 <= m.end() - m.start() <= 37 and 13 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return out


# Generators of candidates: (kind, what a text must hold for the pattern to match at all, pattern).
_NAME = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+"
_LABEL = r"[A-Za-z0-9-]{1,63}"
GENERATORS = (
    ("email", re.compile(r"[\[({<]\s?(?:at|AT)\s?[\])}>]| at | AT |@"), re.compile(rf"{_NAME}\s?(?:[\[({{<]\s?(?:at|AT)\s?[\])}}>]| at | AT |@)\s?{_LABEL}(?:\s?(?:[\[({{<]\s?(?:dot|DOT)\s?[\])}}>]| dot | DOT |\.)\s?{_LABEL}){{1,4}}")),
    # a well-formed number or card inside a longer run of digits that the base pattern takes whole and drops
    ("phone", _DIGIT, re.compile(r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])")),
    ("card", _DIGIT, re.compile(r"(?<![0-9A-Za-z.])[0-9]{13,19}(?![0-9A-Za-z])")),
    ("phone", _DIGIT, re.compile(r"(?<!\+[0-9] )(?<!\+[0-9]{2} )(?<!\+[0-9]{3} )(?<![0-9A-Za-z+.(-])\(?[0-9]{2,4}\)?[ .-]{1,2}[0-9]{3,4}[ .-][0-9]{3,4}(?:[ .-][0-9]{2,4})?(?![0-9A-Za-z])")),
    ("phone", _DIGIT, re.compile(r"(?<![0-9A-Za-z+])00[1-9][0-9]?[ .()-][ .()0-9-]{6,18}[0-9](?![0-9A-Za-z])")),
    ("card", _DIGIT, re.compile(r"(?<![0-9A-Za-z.-])[0-9]{4}(?:[ .\-_/]{1,2}[0-9]{4}){3}(?![0-9A-Za-z])")),
    ("card", _DIGIT, re.compile(r"(?<![0-9A-Za-z.-])3[0-9]{3}[ .\-_/][0-9]{6}[ .\-_/][0-9]{5}(?![0-9A-Za-z])")),
    ("ip", _DIGIT, re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\s?(?:\[\.\]|\(\.\)|\[dot\]|\.)\s?[0-9]{1,3}){3}(?![0-9A-Za-z.])")),
)
#: Words before a span that tell of its kind, or of something else.
CUES = {
    "email": ("mail", "e-mail", "contact", "write", "reach", "send", "correo", "courriel", "kontakt"),
    "phone": ("call", "phone", "tel", "mobile", "fax", "cell", "dial", "teléfono", "téléphone", "telefon"),
    "card": ("card", "visa", "credit", "debit", "mastercard", "amex", "payment", "tarjeta", "carte", "karte"),
    "ip": ("ip", "host", "server", "address", "ping", "login", "from"),
    "other": ("version", "v", "release", "section", "isbn", "order", "ref", "id", "no", "invoice", "date", "chapter", "serial", "score", "page", "pages", "build", "article"),
}
_WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)*")


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """What the generators propose and no base span overlaps."""
    out = set()
    for kind, need, pattern in GENERATORS:
        if need.search(text):
            out.update((kind, *m.span()) for m in pattern.finditer(text))
    # of the spans that begin before an end, the one that reaches furthest tells whether any overlaps
    spans = sorted((a, b) for _, a, b in taken)
    begins, reach = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))
    free = lambda a, b: not (k := bisect_left(begins, b)) or reach[k - 1] <= a
    return sorted(x for x in out if free(x[1], x[2]))


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format and context of a candidate."""
    s, before = text[a:b], text[max(0, a - 60) : a]
    digits = re.sub("[^0-9]", "", s)
    groups = re.findall("[0-9]+", s)
    cue = [w.lower() for w in _WORD.findall(before)[-4:]]
    tail = re.split(r"\W+", s)[-1].lower()
    return [
        KINDS.index(kind), len(s), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        float(len(digits) >= 12 and luhn(digits)), len(set(digits)) / max(1, len(digits)), s.count("."), s.count("-"), s.count(" "), float(s[:1] == "+"),
        float("(" in s or "[" in s), max((int(g) for g in groups if len(g) <= 6), default=0), float(any(len(g) > 1 and g[0] == "0" for g in groups)),
        float(digits[:1] == "0"), float(digits[:1] in "3456" and bool(digits)), float(bool(re.search(r"[\[({<]\s?(?:at|AT)\s?[\])}>]", s))), float(bool(re.search(r"[\[({<]\s?(?:dot|DOT)\s?[\])}>]", s))),
        float(tail in ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info")), len(tail),
        *(float(any(w in CUES[k] for w in cue)) for k in (*KINDS, "other")), float(any(w in CUES[kind] for w in cue)),
        float(kind == "email" and bool(re.match("[A-Za-z0-9%+-]+[._0-9]", s))), float(kind == "email" and bool(re.search("[.][ \\t\\n]", s))),
        float(before[-1:].isalnum()), float(text[b : b + 1].isalnum()), float(text[b : b + 2].strip()[:1] in ("%", "€", "$", "/", "=") and bool(text[b : b + 2].strip())), float(before.rstrip()[-1:] in ("=", "/", "#", "$", "€", "§")),
    ]


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _card(r: random.Random, valid: bool) -> str:
    body = r.choice("3456") + _digits(r, 14)
    good = next(c for c in "0123456789" if luhn(body + c))
    return body + (good if valid else r.choice([c for c in "0123456789" if c != good]))


def compose(seed: int = 11, each: int = EXAMPLES) -> list[tuple[str, str, bool]]:
    """(text, kind wanted or "", positive) examples: made-up words around a span of each kind or something like it."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("an", "the", "or", "en", "ti", "sch", "que", "re", "do", "el", "in", "st")) for _ in range(r.randint(1, 4)))
    host = lambda: r.choice(("example", word(), word() + "-" + word()))
    four = lambda s: r.choice((".", "_", "/", " - ", ". ", "  ")).join(s[i : i + 4] for i in range(0, 16, 4))
    plain = lambda name: f"{name}{r.choice((' at ', ' at ', ' AT '))}{host()}.{r.choice(('com', 'org', 'net', 'de', 'fr', 'es'))}"
    good = {
        "email": lambda: plain(f"{word()}{r.choice(('.', '_', ''))}{word()}") if r.random() < 0.2 else f"{word()}{r.choice(('', '.', '_'))}{word()}{r.choice((' [at] ', '[at]', ' (at) ', ' at ', '(AT)', ' AT '))}{host()}{r.choice((' [dot] ', '[dot]', ' dot ', '(dot)', ' DOT '))}{r.choice(('com', 'org', 'net', 'de', 'fr', 'es'))}",
        "phone": lambda: r.choice(("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "({})-{}-{}", "001 {} {} {}", "0049 {} {}{}", "+1 ({}) {}-{} " + _card(r, True), "+34 {} {}-{} " + _digits(r, 12))).format(str(r.randint(201, 989)), str(r.randint(200, 999)), _digits(r, 4)),
        "card": lambda: r.choice((four(_card(r, True)), f"{_digits(r, 3)}-{_digits(r, 4)} {_card(r, True)}", f"{_card(r, True)} {_digits(r, r.randint(5, 12))}")),
        "ip": lambda: r.choice(("[.]", "(.)", "[dot]", " . ")).join(str(r.randint(1, 255)) for _ in range(4)),
    }
    bad = {
        "email": lambda: r.choice((f"{word()} at {word()} {word()} dot {word()}", f"{word()} at {word()}. {word().title()}", f"{word()} at the {word()} dot {word()}", f"look at {word()} dot {word()}", plain(r.choice(("look", "stay", "found", "read", "shop", word()))), f"{word()} at {word()}.{word()}")),
        "phone": lambda: r.choice((f"{r.randint(1900, 2099)}-{_digits(r, 4)}-{_digits(r, 3)}", f"{_digits(r, 3)} {_digits(r, 3)} {_digits(r, 3)}", f"{_digits(r, 2)} {_digits(r, 4)} {_digits(r, 4)}", f"{_digits(r, 4)}.{_digits(r, 4)}.{_digits(r, 4)}", f"{_digits(r, 2)}.{_digits(r, 3)}.{_digits(r, 3)}", f"{_digits(r, 4)} {_digits(r, 4)} {_digits(r, 4)} {_digits(r, 4)}")),
        "card": lambda: r.choice((four(_card(r, False)), f"{_digits(r, 3)}-{_digits(r, 4)} {_card(r, False)}", _card(r, False), _digits(r, r.choice((13, 14, 17, 18, 19))))),
        "ip": lambda: r.choice((".".join(str(r.randint(256, 999)) for _ in range(4)), f"{r.randint(1, 9)}. {r.randint(1, 9)}. {r.randint(1, 9)}. {r.randint(1, 9)}", "[.]".join(str(r.randint(300, 999)) for _ in range(4)))),
    }
    out = []
    for kind in KINDS:
        for k in range(2 * each):
            positive = k % 2 == 0
            cue = r.choice(CUES[kind] if r.random() < (0.6 if positive else 0.15) else CUES["other"] if not positive and r.random() < 0.6 else (word(),))
            span = (good if positive else bad)[kind]()
            out.append((f"{word()} {word()} {cue}{r.choice((' ', ': ', ' is '))}{span}{r.choice((' ', '. ', ', '))}{word()} {word()}", kind, positive))
    return out


@cache
def trained(examples: int = EXAMPLES, precision: float = PRECISION) -> Calibrated:
    """The model over candidates of composed examples; the same on every call."""
    rows, labels = [], []
    for text, kind, positive in compose(each=examples):
        for k, a, b in candidates(text, base_spans(text)):
            rows.append(features(text, k, a, b))
            # a good example may hold several spans; digits beside it count by their own form
            d = re.sub("[^0-9]", "", text[a:b])
            labels.append(float(positive and k == kind and (k != "card" or luhn(d)) or positive and k == "card" and kind == "phone" and luhn(d)))
    of = np.array([int(r[0]) for r in rows])
    return Calibrated(np.array(rows), np.array(labels), of, precision)


def select(texts: list[str], model: Calibrated) -> Iterator[tuple[list, list]]:
    """(base spans, added spans with their probability) of each text."""
    bases = [base_spans(t) for t in texts]
    proposed = [(i, *c) for i, t in enumerate(texts) for c in candidates(t, bases[i])]
    added: list[list] = [[] for _ in texts]
    if proposed:
        of = np.array([KINDS.index(k) for _, k, _, _ in proposed])
        p = model.probability(np.array([features(texts[i], k, a, b) for i, k, a, b in proposed]), of)
        order = sorted(np.flatnonzero(p >= model.threshold[of]).tolist(), key=lambda j: (-p[j], proposed[j]))
        taken: list[list[tuple[int, int]]] = [[] for _ in texts]  # sorted and apart
        for j in order:
            i, kind, a, b = proposed[j]
            at = bisect_left(taken[i], (a, b))
            if (at == 0 or taken[i][at - 1][1] <= a) and (at == len(taken[i]) or b <= taken[i][at][0]):
                taken[i].insert(at, (a, b))
                added[i].append((kind, a, b, float(p[j])))
    yield from zip(bases, added)


def named(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def pii_spans(docs: DataFrame, examples: int = EXAMPLES, precision: float = PRECISION) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added, redacted.

    ``redacted`` is the text with every span replaced by its kind in brackets.
    """
    model = trained(examples, precision)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            out: dict[str, list] = {k: [] for k in (*KINDS, "base_sha256", "spans", "n_added", "redacted")}
            for text, (base, added) in zip(texts, select(texts, model)):
                spans = base + [s[:3] for s in added]
                for k in KINDS:
                    out[k].append(sum(s[0] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(named(base).encode()).hexdigest())
                out["spans"].append(named(spans))
                out["n_added"].append(len(added))
                parts, at = [], 0
                for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
                    if a >= at:
                        parts += [text[at:a], f"[{kind}]"]
                    at = max(at, b)
                out["redacted"].append("".join(parts) + text[at:])
            kinds = [pa.array(out[k], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *kinds, pa.array(out["base_sha256"]), pa.array(out["spans"]), pa.array(out["n_added"], pa.int64()), pa.array(out["redacted"])], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "redacted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id BIGINT, n_email BIGINT, n_ip BIGINT, n_card BIGINT, n_phone BIGINT, base_sha256 STRING, spans STRING, n_added BIGINT, redacted STRING")


def op3_pii_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(table(spark, sf_dir, "documents")).drop("redacted")
