"""Plain single-machine versions that the distributed operators are held against."""

from __future__ import annotations

import hashlib
import re

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")

# numbers and keys that only a word near them confirms; what runs on behind a number belongs to the match and fails its check
LOCAL_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]|(?<![A-Za-z0-9.,@_-])\(?[0-9]++(?:[ ()/-]{1,2}+[0-9]++)*+(?:[A-Za-z@_]|[.,:][0-9])?+")
ACCOUNT = re.compile(r"(?<![A-Za-z0-9.,@_+-])[A-Za-z]{0,2}+[0-9]++(?:[A-Za-z@_]|[.,:-][0-9])?+")
RUN = re.compile(r"[A-Za-z0-9_-]+")
CONTEXT = {
    "local_phone": r"\b(phone|call|tel|telephone|mobile|cell|fax|telefon|telefono|teléfono|téléphone|handy|móvil)\b",
    "account": r"\b(account|acct|passport|customer (no|number|id)|ssn|konto|kontonummer|kundennummer|ausweis|cuenta|pasaporte|compte|passeport)\b",
    "secret": r"\b(token|secret|password|passwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|credentials?|bearer|passwort|contraseña)\b",
}


def _near(kind: str, text: str, gaps: tuple[int, int], start: int, end: int) -> bool:
    """Whether a word of the kind stands within 40 code points, up to the matches before and after."""
    near = text[max(gaps[0], start - 40):start] + " " + text[end:min(gaps[1], end + 40)]
    return re.search(CONTEXT[kind], near.lower()) is not None


def context_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    rules = {
        "local_phone": (LOCAL_PHONE, lambda m: re.fullmatch(r"[0-9(][0-9 ()/-]*[0-9]", m) and 7 <= sum(c.isdigit() for c in m) <= 12),
        "account": (ACCOUNT, lambda m: re.fullmatch("[A-Za-z]{0,2}[0-9]{6,18}", m)),
        "secret": (RUN, lambda m: len(m) <= 128 and re.search("[0-9]", m) and re.search("[A-Za-z]", m)),
    }
    out = {}
    for kind, (pattern, ok) in rules.items():
        spans = [m.span() for m in pattern.finditer(text) if kind != "secret" or len(m.group()) >= 24]
        edges = [0, *[x for s in spans for x in s], len(text)]
        out[kind] = [(a, b) for i, (a, b) in enumerate(spans) if ok(text[a:b]) and _near(kind, text, (edges[2 * i], edges[2 * i + 3]), a, b)]
    return out


def luhn_ok(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def pii_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    digits = lambda m: re.sub("[^0-9]", "", m)
    checks = {
        "email": (EMAIL, lambda m: True),
        "ip": (IP, lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (CARD, lambda m: 13 <= len(digits(m)) <= 19 and luhn_ok(digits(m))),
        "phone": (PHONE, lambda m: 9 <= len(digits(m)) <= 15),
        "iban": (IBAN, iban_ok),
    }
    return {k: [m.span() for m in p.finditer(text) if ok(m.group())] for k, (p, ok) in checks.items()}


def pii_row(text: str | None) -> tuple:
    found = {**pii_spans(text or ""), **context_spans(text or "")}
    joined = lambda kinds: ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])
    base = ("email", "ip", "card", "phone")
    return (*[len(found[k]) for k in base], hashlib.sha256(joined(base).encode()).hexdigest(), joined((*base, "iban", "local_phone", "account", "secret")))
