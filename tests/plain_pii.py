"""Masking of one text, step by step: what the spans on the JVM are held against."""

from __future__ import annotations

import re

from corpusloom.operators.safety import _DIGITS, PII


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mask_text(text: str) -> tuple[str, list[str]]:
    """Spans by start, then length, then order of patterns; overlapping later ones are passed over."""
    spans = []
    for name, pattern in PII.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m[0])
            lo, hi = _DIGITS.get(name, (0, 1 << 30))
            if lo <= len(digits) <= hi and (name != "CREDIT_CARD" or luhn(digits)):
                spans.append((m.start(), m.end(), name))
    out, at, types = [], 0, []
    for a, b, name in sorted(spans, key=lambda s: (s[0], s[0] - s[1])):
        if a >= at:
            out += [text[at:a], f"[{name}_REDACTED]"]
            at = b
            types.append(name)
    return "".join([*out, text[at:]]), list(dict.fromkeys(types))
