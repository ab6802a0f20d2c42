"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, schemes, plus signs, digits and identifier cues) in one pass over
a text. From each anchor a deterministic parser of its kind walks outwards to the boundaries and validates
what it has. No pattern is searched in the text as a whole.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.llm.text import whole

DIGITS = frozenset("0123456789")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
HEX = frozenset("0123456789abcdefABCDEF")
LOCAL, LABEL = ALNUM | frozenset("._%+-"), ALNUM | frozenset("-")
CUE, SECRET = ALNUM | {"_"}, LABEL | {"_"}
PHONE = DIGITS | frozenset(" ().-")
URL_END = frozenset(" \t\r\n\v\f<>\"'`|\\^{}[]")
#: Kinds in the order that breaks ties between spans of one start: the base kinds first.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "secret")
SCHEMES = ("https://", "http://", "ftp://")
#: Cues before an account number or a secret, in lower case; a value of ACCOUNT or SECRET characters follows.
CUES = ("iban", "token", "api_key", "apikey", "secret", "password")
BRIDGE = frozenset(" \t:=\"'")
MIN_SECRET = 16


def _automaton():
    a = ahocorasick.Automaton()
    for c in "@+":
        a.add_word(c, c)
    for c in DIGITS:
        a.add_word(c, "digit")
    for s in SCHEMES:
        a.add_word(s, s)
    for s in CUES:
        a.add_word(s, s)
    a.make_automaton()
    return a


_AUTOMATON = _automaton()


def anchors(text: str) -> dict[str, list[int]]:
    """Starts of the anchors of each kind, ascending. Cues and schemes are found in any case of A-Z."""
    found: dict[str, list[int]] = {"@": [], "+": [], "digit": [], "scheme": [], "cue": []}
    # Lower-casing may change a text's length beyond ASCII; then only A-Z are changed.
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if c.isascii() else c for c in text)
    last = -2
    for end, key in _AUTOMATON.iter(low):
        if key == "digit":
            if end != last + 1:
                found["digit"].append(end)  # a run of digits counts once, at its start
            last = end
        elif len(key) == 1:
            found[key].append(end)
        else:
            found["scheme" if key in SCHEMES else "cue"].append(end + 1 - len(key))
    return found


def _run(text: str, at: int, chars: frozenset) -> int:
    """End of the run of `chars` that starts at `at`."""
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def emails(text: str, ats: list[int]) -> list[tuple[int, int]]:
    """Local part to the left of each at-sign as far as it and the last address allow, then two labels or more."""
    out, free = [], 0
    for at in ats:
        if at < free:
            continue
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        end = _run(text, at + 1, LABEL)
        if start == at or end == at + 1:
            continue
        labels = 1
        while end < len(text) and text[end] == "." and (after := _run(text, end + 1, LABEL)) > end + 1:
            end, labels = after, labels + 1
        if labels > 1:
            out.append((start, end))
            free = end
    return out


def addresses(text: str, digits: list[int]) -> list[tuple[int, int]]:
    """Four runs of digits with single dots between; each at most 255."""
    out, free = [], 0
    for start in digits:
        if start < free:
            continue
        parts, end = [], start
        while True:
            after = _run(text, end, DIGITS)
            parts.append(text[end:after])
            if len(parts) == 4 or after >= len(text) or text[after] != "." or after + 1 >= len(text) or text[after + 1] not in DIGITS:
                break
            end = after + 1
        if len(parts) == 4:
            free = after
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
                out.append((start, after))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def cards(text: str, digits: list[int]) -> list[tuple[int, int]]:
    """Digits with single spaces or hyphens between; 14 to 19 of them, with a right check digit."""
    out, free = [], 0
    for start in digits:
        if start < free:
            continue
        end = _run(text, start, DIGITS)
        while end + 1 < len(text) and text[end] in " -" and text[end + 1] in DIGITS:
            end = _run(text, end + 1, DIGITS)
        free = end
        if end - start >= 14:
            plain = text[start:end].replace(" ", "").replace("-", "")
            if 14 <= len(plain) <= 19 and luhn(plain):
                out.append((start, end))
    return out


def phones(text: str, pluses: list[int]) -> list[tuple[int, int]]:
    """A plus sign, then digits with the usual marks between; 10 to 15 digits."""
    out, free = [], 0
    for start in pluses:
        if start < free or start + 1 >= len(text) or text[start + 1] not in DIGITS:
            continue
        end = _run(text, start + 2, PHONE)
        while end > start + 2 and text[end - 1] not in DIGITS:
            end -= 1
        if end <= start + 3:  # nothing stands between the first and the last digit
            continue
        free = end
        if 10 <= sum(c in DIGITS for c in text[start:end]) <= 15:
            out.append((start, end))
    return out


def urls(text: str, schemes: list[int]) -> list[tuple[int, int]]:
    """From a scheme to white space or a delimiter, without marks at the end; the host needs a letter or digit."""
    out, free = [], 0
    for start in schemes:
        if start < free or (start and text[start - 1] in ALNUM):
            continue
        host = text.index("://", start) + 3
        if host == len(text) or text[host] not in ALNUM:
            continue
        end = host + 1
        while end < len(text) and text[end] not in URL_END and not text[end].isspace():
            end += 1
        while text[end - 1] in ".,;:!?)*%&$#":
            end -= 1
        out.append((start, end))
        free = end
    return out


def iban_ok(value: str) -> bool:
    if not 15 <= len(value) <= 34 or not value[:2].isalpha() or not value[2:4].isdigit():
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def cued(text: str, cues: list[int]) -> list[tuple[str, int, int]]:
    """After a cue and a bridge of spaces, colons, equals signs or quotes: an IBAN that checks, or a long secret with a digit.

    Cues of one run of letters share its bridge and its value, which is read once for each kind.
    """
    out, free, end, start, tried = [], 0, -1, -1, set()
    for cue in cues:
        if cue and text[cue - 1] in ALNUM:
            continue
        if cue >= end:
            end = _run(text, cue, CUE)
            start = _run(text, end, BRIDGE)
            tried.clear()
        iban = text[cue : cue + 4].lower() == "iban"
        if start == end or start < free or start >= len(text) or iban in tried:
            continue
        tried.add(iban)
        if iban:
            stop, value = start, ""
            while stop < len(text) and len(value) < 34 and (text[stop] in ALNUM or text[stop] == " " and stop + 1 < len(text) and text[stop + 1] in ALNUM):
                value += text[stop].strip().upper()
                stop += 1
            while len(value) >= 15 and not iban_ok(value):
                stop -= 1
                value = text[start:stop].replace(" ", "").upper()
            while text[stop - 1] == " ":
                stop -= 1
            if iban_ok(value):
                out.append(("iban", start, stop))
                free = stop
        elif (stop := _run(text, start, SECRET)) - start >= MIN_SECRET and any(c in DIGITS for c in text[start:stop]):
            out.append(("secret", start, stop))
            free = stop
    return out


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) in code points, by start, then by KINDS."""
    a = anchors(text)
    found = [(k, *x) for k, f, key in (("email", emails, "@"), ("ip", addresses, "digit"), ("card", cards, "digit"), ("phone", phones, "+"), ("url", urls, "scheme")) for x in f(text, a[key])]
    found += cued(text, a["cue"])
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPANS = T.StructType([*[T.StructField(f"n_{k}", T.LongType()) for k in BASE], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def _spans(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        found = find_spans(t)
        base = [x for x in found if x[0] in BASE]
        join = lambda xs: ",".join(f"{k}:{s}:{e}" for k, s, e in xs)
        rows.append([*[sum(x[0] == k for x in base) for k in BASE], hashlib.sha256(join(base).encode()).hexdigest(), join(found)])
    return pd.DataFrame(rows, columns=SPANS.names)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Spans are kind:start:end in code points, joined by commas; base_sha256 hashes those of the four base
    kinds. A null text counts as empty: no spans, and the hash of an empty string. Of spans with one start the kinds'
    order decides. A text of any length is read whole, in time in proportion to it. Repeated rows give repeated rows, an
    empty table an empty result; other columns are ignored.
    """
    return docs.select(id_col, F.pandas_udf(_spans, SPANS)(whole(F.col(text_col))).alias("_s")).select(id_col, "_s.*")


def redact(text: str, spans: list[tuple[str, int, int]] | None = None) -> str:
    """`text` with each span replaced by <KIND>; of overlapping spans the first one counts."""
    out, free = [], 0
    for kind, start, end in find_spans(text) if spans is None else spans:
        if start >= free:
            out += [text[free:start], f"<{kind.upper()}>"]
            free = end
    return "".join(out) + text[free:]
