"""Operator 10: personal data in texts. Patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from duskboard.llm.spans import Span, scan

BASE = ("email", "ip", "card", "phone")
ORDER = {kind: i for i, kind in enumerate((*BASE, "iban", "ssn"))}
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A run of digits that fails from its start fails from any later place, so matches start where runs do.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Characters of an IBAN by country.
IBAN_LENGTHS = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 "
    "GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 "
    "NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
).split()}
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: Score of a confirmed span; words of its kind nearby add to it.
SCORES = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "client"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "tarjeta", "carte", "karte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
WINDOW, BONUS = 40, 0.2
WORD = re.compile(r"\w+(?:-\w+)*")


def luhn(digits: str) -> bool:
    """Every second digit from the right is doubled; the digits of all must add up to a multiple of ten."""
    doubled = (int(d) * 2 for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def mod97(iban: str) -> bool:
    """The country and check digits go to the end, letters count from 10; the number must leave 1 modulo 97."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def ibans(text: str) -> list[tuple[int, int]]:
    """Leftmost, not overlapping. Words and numbers may follow: a proposal is cut at its country's length, or else taken
    whole; of an unknown country each end of a word is tried, the longest first."""
    out, at = [], 0
    while m := IBAN.search(text, at):
        own, wanted = m[0], IBAN_LENGTHS.get(m[0][:2])
        ends = [i for i in range(len(own), 14, -1) if i == len(own) or own[i] == " "]
        if wanted:
            ends = [i for i in ends if i - own[:i].count(" ") == wanted] + ends[:1]
        at = m.start() + 1
        for i in ends:
            if 15 <= len(x := own[:i].replace(" ", "")) <= 34 and mod97(x):
                at = m.start() + i
                out.append((m.start(), at))
                break
    return out


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, not overlapping. It goes from @ to @, so a long run without one costs nothing."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def find_in(text: str) -> list[Span]:
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", a, b) for a, b in emails(text)]
    found += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    if "." in text:
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    found += [("iban", a, b) for a, b in ibans(text)]
    if "-" in text:
        found += [("ssn", *m.span()) for m in SSN.finditer(text)]
    out = []
    for kind, a, b in found:
        near = {w.lower() for w in WORD.findall(text[max(0, a - WINDOW) : a] + "\n" + text[b : b + WINDOW])}
        hits = len(near.intersection(CONTEXT[kind]))
        out.append((kind, a, b, round(min(1.0, SCORES[kind] + BONUS * hits), 2)))
    return sorted(out, key=lambda s: (ORDER[s[0]], s[1]))


def find_personal_data(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data per row, by kind, then start: e-mail and IP addresses, card and phone numbers, IBANs,
    and social security numbers, which only words nearby raise to ``least``. The base kinds stay at any score.
    See ``spans.scan`` for nulls, repeats and extra columns. Kinds may overlap."""

    def scanner() -> Callable[[str], list[Span]]:
        return lambda text: [s for s in find_in(text) if s[0] in BASE or s[3] >= least]

    return scan(docs, scanner, id_col, text_col)
