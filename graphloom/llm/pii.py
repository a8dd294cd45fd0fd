"""Personal data: high-recall generators propose overlapping spans, boosted trees select among them.

Four kinds: email, ip, card, phone. Generators of two sorts propose candidate spans: the strict forms (the base,
always kept) and loose forms (spelled-out addresses, telephone numbers without a country prefix or with digits
after them, card numbers with other separators or beside other digits). Every candidate gets features of its format and of the text around it; boosted trees trained
on generated examples score it; per kind, the threshold is the lowest score at which held-back examples reach
``PRECISION``. A loose span that overlaps a kept span is dropped, the better score first
(ties: by kind, then start).

Whole texts are read. The strict forms are found in linear time: each start is tried once.

Defined results: null and empty texts give no spans; repeated rows give repeated results; extra columns are ignored;
an empty table gives an empty result. Offsets are in code points, end exclusive.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import boosting, common

KINDS = ("email", "ip", "card", "phone")
#: Share of selected held-back examples that must be true, for the thresholds.
PRECISION = 0.995
#: Characters of context to either side that the features see.
AROUND = 24

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: The loose generators. Their lengths are those of the formats: 64 characters before the @ sign and 63 in a part of a domain name at most
#: (RFC 5321, RFC 1035).
_LOOSE = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[({<] ?(?:dot|DOT|\.) ?[\])}>] ?)[A-Za-z0-9-]{1,63}){1,4}")),
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} (?:at|AT) [A-Za-z0-9-]{1,63}(?: (?:dot|DOT) [A-Za-z0-9-]{1,63}){1,4}")),
    ("phone", re.compile(r"(?<![0-9A-Za-z+.-])(?:00[1-9][0-9]{0,2}[ .-])?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z]|[.-][0-9A-Za-z])")),
    ("phone", re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9A-Za-z.+])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9A-Za-z])")),
    ("card", re.compile(r"(?<![0-9A-Za-z.])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9A-Za-z])")),
)
_CUES = (
    re.compile(r"mail|contact|write|reach|e-?post|courriel|correo", re.I),
    re.compile(r"phone|tel|call|mobile|fax|cell|ring|whatsapp", re.I),
    re.compile(r"card|visa|master|amex|payment|credit|debit", re.I),
    re.compile(r"\bip\b|host|server|address|login|from", re.I),
    re.compile(r"order|isbn|version|invoice|serial|id\b|no\.|ref|date|page|item", re.I),
)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping strict addresses: the run of local characters before an @ that a domain follows."""
    out, past, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            past = m.end()
            at = text.find("@", past)
        else:
            past, at = at + 1, text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The strict spans by kind as listed, then start."""
    out = [("email", *x) for x in emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p := g.lstrip("0")) <= 3 and int(p or "0") <= 255 for g in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def features(text: str, kind: str, start: int, end: int, strict: bool) -> list[float]:
    """Format of the span and cues around it."""
    span, before, after = text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND]
    digits = _NOT_DIGIT.sub("", span[:64])
    groups = re.findall(r"[0-9]+", span[:64])
    return [
        *(float(kind == k) for k in KINDS), float(strict), float(min(len(span), 64)), float(len(digits)), float(len(groups)),
        float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)), float(len({c for c in span if not c.isalnum()})),
        float("(" in span), float("[" in span or "{" in span), float(luhn(digits) if digits else False), float(len(set(digits))),
        float(bool(re.match(r"(?:19|20)[0-9]{2}[ .-]", span))), float(before[-1:].isalnum()), float(after[:1].isalnum()),
        *(float(bool(c.search(before))) for c in _CUES), float(sum(c.isdigit() for c in before)), float(sum(c.isdigit() for c in after)),
    ]


def examples(seed: int = 7, count: int = 1500) -> list[tuple[str, str, int, int, bool, int]]:
    """Generated (text, kind, start, end, strict, label): personal data in context, and look-alikes."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    num = lambda n: "".join(str(rng.integers(10)) for _ in range(n))
    word = lambda: "".join(chr(97 + rng.integers(26)) for _ in range(rng.integers(2, 9)))

    def card(sep: str) -> str:
        d = num(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    out = []
    for _ in range(count):
        sep, wrap = pick(" ", "-", "."), pick("[]", "()", "{}")
        cases = [
            (f"{word()}{wrap[0]}at{wrap[1]}{word()}{wrap[0]}dot{wrap[1]}com", "email", 1, pick("mail me: ", "contact ", "write to ", "")),
            (f"{word()} at {word()} dot {word()}", "email", 1, pick("mail me: ", "contact ", "e-mail ")),
            (f"{word()} at {word()} dot {word()}", "email", 0, pick("look ", "the ", "stand ", "")),
            (f"({num(3)}) {num(3)}-{num(4)}", "phone", 1, pick("call ", "tel. ", "phone: ", "")),
            (f"{num(3)}{sep}{num(3)}{sep}{num(4)}", "phone", 1, pick("call ", "tel. ", "phone: ", "mobile ")),
            (f"{pick('19', '20')}{num(2)}{sep}{num(3)}{sep}{num(4)}", "phone", 0, pick("date ", "version ", "")),
            (f"{num(3)}{sep}{num(3)}{sep}{num(3)}", "phone", 0, pick("order ", "serial ", "invoice ", "item ", "ref ", "isbn ", "")),
            (f"{num(4)}{sep}{num(4)}{sep}{num(4)}", "phone", 0, pick("order ", "serial ", "id ", "")),
            (card(pick(".", "/", "_")), "card", 1, pick("card ", "visa ", "payment with ", "")),
            (pick(".", "/", "_").join([num(4) for _ in range(4)]), "card", 0, pick("serial ", "id ", "invoice ", "")),
            (f"+{rng.integers(1, 99)} ({num(3)}) {num(3)}-{num(4)}", "phone", 1, pick("tel ", word() + " ", "")),
            (card(pick("", " ", "-")), "card", 1, pick("card ", word() + " ", num(3) + " ", "")),
            (pick("", " ", "-").join([num(4) for _ in range(4)]), "card", 0, pick("serial ", word() + " ", num(3) + " ", "")),
            (f"{word()}@{word()}.{word()}", "email", 1, pick("mail ", word() + " ", "")),
            (".".join(str(rng.integers(256)) for _ in range(4)), "ip", 1, pick("from ", "host ", word() + " ")),
            (card(pick("", " ", "-")), "card", 1, pick("card ", word() + " ", "")),
            (f"+{rng.integers(1, 99)} {num(3)} {num(3)} {num(4)}", "phone", 1, pick("tel ", word() + " ", "")),
        ]
        for k, (span, kind, label, before) in enumerate(cases):
            head = f"{word()} {before}"
            text, at = f"{head}{span} {pick(word(), word(), num(5))} {word()}", len(head)
            if kind == "card" and not label and luhn(_NOT_DIGIT.sub("", span)):
                continue
            out.append((text, kind, at, at + len(span), k >= 13, label))
    return out


@functools.cache
def trained(seed: int = 7) -> tuple[boosting.Boosted, dict[str, float]]:
    """The trees and the calibrated threshold of each kind (every third example is held back)."""
    rows = examples(seed, 250)
    x = np.array([features(*r[:5]) for r in rows])
    y = np.array([r[5] for r in rows], float)
    held = np.arange(len(rows)) % 3 == 2
    model = boosting.fit(x[~held], y[~held])
    p, thresholds = model.predict(x[held]), {}
    for kind in KINDS:
        mine = np.array([r[1] == kind and not r[4] for r in rows])[held]
        order = np.argsort(-p[mine])
        good = np.cumsum(y[held][mine][order]) / np.arange(1, mine.sum() + 1)
        enough = np.flatnonzero(good >= PRECISION)
        thresholds[kind] = max(0.5, float(p[mine][order][enough[-1]])) if len(enough) else 2.0
    return model, thresholds


def find(text: str | None, model: boosting.Boosted, thresholds: dict[str, float]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(strict spans, all kept spans) of a text, each by kind as listed, then start."""
    text = text or ""
    base = base_spans(text)
    loose = [(kind, *m.span()) for kind, pattern in _LOOSE for m in pattern.finditer(text)]
    taken = Taken((s, e) for _, s, e in base)
    loose = [x for x in dict.fromkeys(loose) if taken.free(x[1], x[2])]
    kept = list(base)
    if loose:
        score = model.predict(np.array([features(text, *x, False) for x in loose]))
        for i in sorted(range(len(loose)), key=lambda i: (-score[i], loose[i])):
            kind, s, e = loose[i]
            if score[i] >= thresholds[kind] and taken.free(s, e):
                taken.add(s, e)
                kept.append(loose[i])
    return base, sorted(kept, key=lambda x: (KINDS.index(x[0]), x[1]))


class Taken:
    """Disjoint intervals in order: whether a span meets none is found by bisection."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(e, self.ends[-1])
            else:
                self.starts.append(s)
                self.ends.append(e)

    def free(self, start: int, end: int) -> bool:
        i = bisect.bisect_left(self.starts, end)
        return i == 0 or self.ends[i - 1] <= start

    def add(self, start: int, end: int) -> None:
        i = bisect.bisect_left(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by [KIND]; overlapping spans make one replacement, by the first's kind."""
    out, past = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= past:
            out += [text[past:s], f"[{kind.upper()}]"]
        past = max(past, e)
    return "".join([*out, text[past:]])


def _possible(text: pa.Array) -> np.ndarray:
    """False where no generator can match: a text without digits and without an "at"."""
    return pc.match_substring_regex(text, r"[0-9@]|[\[({<] ?(at|AT)| (dot|DOT) ").to_numpy(zero_copy_only=False)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""
    model, thresholds = trained()

    def run(batches):
        nothing = ((), ())
        for batch in batches:
            text = common.large(batch.column(1))
            base, all_ = [], []
            for i, some in enumerate(_possible(text)):
                b, a = find(text[i].as_py(), model, thresholds) if some else nothing
                base.append(b)
                all_.append(a)
            counts = [pa.array([sum(k == kind for k, _, _ in b) for b in base], pa.int64()) for kind in KINDS]
            sha = [hashlib.sha256(joined(b).encode()).hexdigest() for b in base]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(sha, pa.string()), pa.array(map(joined, all_), pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return common.bounded(docs).select("doc_id", "text").mapInArrow(common.kernel(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced by its kind, and n_chars (where present) to match."""
    model, thresholds = trained()
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            text = common.large(column)
            hit = _possible(text)
            new = column.to_pylist()
            for i in np.flatnonzero(hit):
                if spans := find(new[i], model, thresholds)[1]:
                    new[i] = redacted(new[i], spans)
            columns = list(batch.columns)
            columns[at] = pa.array(new, column.type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = common.bounded(docs).mapInArrow(common.kernel(run), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(common.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data is replaced; every document stays."""
    return redact(docs)


QUERIES = {"op8_pii": op8_pii}
SQL: dict[str, str] = {}
