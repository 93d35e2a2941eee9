"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors - at-signs, schemes, digits, plus signs and identifier cues - in one pass
over the lower-cased text; small deterministic parsers expand each anchor to its boundaries and validate it: numbers of
an internet address, Luhn's and the modulus 97 checksum, the ranges of social security numbers, assignments of secrets.  The base kinds (email, ip, card,
phone) are exactly the leftmost non-overlapping matches of their patterns; the other kinds only add spans.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.llm.common import by_parts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url_login", "credential", "account")
SPANS = "array<struct<kind:string,start:int,end:int>>"
#: Cues of the added kinds, in lower case; texts are searched without regard to case.
CREDENTIAL_CUES = (
    "password", "passwd", "passphrase", "passcode", "pwd", "secret", "secret_key", "secret-key", "secret key", "client_secret", "api_key", "api-key", "api key", "apikey",
    "access_key", "access-key", "access key", "accesskey", "private_key", "private key", "token", "auth_key", "auth key", "bearer", "credential",
)
ACCOUNT_CUES = {
    "iban": "iban", "ssn": "ssn", "social security number": "ssn", "social security no": "ssn", "account number": "number", "account no": "number",
    "account #": "number", "account id": "number",
    "acct": "number", "a/c no": "number", "routing number": "number", "customer number": "number", "card number": "number", "passport": "passport",
    "tax id": "number", "licence number": "passport", "license number": "passport",
}
#: Secrets that are known by how they begin, and how they go on.
TOKEN_FORMS = {
    "akia": r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])", "ghp_": r"ghp_[0-9A-Za-z]{36}", "gho_": r"gho_[0-9A-Za-z]{36}",
    "github_pat_": r"github_pat_[0-9A-Za-z_]{22,}", "xoxb-": r"xoxb-[0-9A-Za-z-]{10,}", "xoxp-": r"xoxp-[0-9A-Za-z-]{10,}",
    "eyj": r"eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]+", "-----begin": r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----",
}
_TOKENS = {cue: re.compile(form, re.S) for cue, form in TOKEN_FORMS.items()}
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOGIN = re.compile(r"://[^\s/@:<>\"]+:([^\s/@<>\"]+)@")
#: What stands between a cue and its secret, and the secret: in quotes, or up to white space or a delimiter.
_ASSIGNED = re.compile(r"""[\w-]{0,16}["'`\])]{0,2}\s{0,3}(:=|=>|->|=|:|\bis\b)\s{0,3}(?:[Bb]earer\s+|[Bb]asic\s+)?(?:"([^"\n]{4,})"|'([^'\n]{4,})'|`([^`\n]{4,})`|([^\s,;"'`<>]{4,}))""")
_BEARER = re.compile(r"\s+([0-9A-Za-z._~+/=-]{16,})")
_LEAD = re.compile(r"(?i)(?:\s?(?:number|num|no|id|code))?\.?\s{0,2}(?:is\b)?\s{0,2}[:#=]{0,2}\s{0,2}")
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[ -]?[A-Za-z0-9]){11,30}")
_SSN = re.compile(r"([0-9]{3})([- ]?)([0-9]{2})\2([0-9]{4})(?![0-9])")
_NUMBER = re.compile(r"[A-Za-z]{0,3}[0-9](?:[ -]?[0-9]){5,33}(?![0-9A-Za-z])")
_PASSPORT = re.compile(r"[A-Za-z]{0,3}[0-9]{6,12}(?![0-9A-Za-z])")


@lru_cache(1)
def anchors() -> ahocorasick.Automaton:
    """The automaton over lower-cased texts; its values are what an anchor calls for and its length."""
    out = ahocorasick.Automaton()
    for d in "0123456789":
        out.add_word(d, ("digit", 1))
        out.add_word("+" + d, ("plus", 2))
    out.add_word("@", ("at", 1))
    out.add_word("://", ("scheme", 3))
    for cue in CREDENTIAL_CUES:
        out.add_word(cue, ("credential", len(cue)))
    for cue in ACCOUNT_CUES:
        out.add_word(cue, (cue, len(cue)))
    for cue in TOKEN_FORMS:
        out.add_word(cue, (cue, len(cue)))
    out.make_automaton()
    return out


def lowered(text: str) -> str:
    """The text in lower case, position for position."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def iban_length(written: str) -> int:
    """How much of a written account number, up to one of its group ends, passes the checksum of modulus 97; 0 if nothing does."""
    ends = [i for i in range(len(written), 0, -1) if i == len(written) or not written[i].isalnum()]
    for end in ends:
        compact = written[:end].replace(" ", "").replace("-", "").upper()
        if 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1:
            return end
    return 0


def account(text: str, at: int, form: str) -> tuple[int, int] | None:
    """Bounds of the valid account number of a form that follows a cue that ends at ``at``."""
    at = _LEAD.match(text, at).end()
    if form == "iban":
        m = _IBAN.match(text, at)
        size = iban_length(m[0]) if m else 0
        return (at, at + size) if size and not text[at + size : at + size + 1].isalnum() else None
    if form == "ssn":
        m = _SSN.match(text, at)
        return m.span() if m and m[1] not in ("000", "666") and m[1] < "900" and m[3] != "00" and m[4] != "0000" else None
    m = (_PASSPORT if form == "passport" else _NUMBER).match(text, at)
    return m.span() if m else None


def secret(text: str, at: int) -> tuple[int, int] | None:
    """Bounds of the secret that is assigned to a cue that ends at ``at``.

    Prose has colons too: a bare value after one counts only with a digit or a symbol in it.
    """
    if m := _ASSIGNED.match(text, at):
        bare = m[5] is not None
        a, b = m.span(m.lastindex)
        if bare:
            b = a + len(m[5].rstrip(".!?)]}"))
        value = text[a:b]
        if len(value) >= 4 and not (bare and m[1] not in ("=", ":=") and value.isalpha()) and not (m[1] == "is" and not any(c.isdigit() for c in value)):
            return a, b
    return None


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d)
        if i % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans, by kind in the order of ``KINDS``, then start; ends are exclusive code point offsets."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    past = dict.fromkeys(KINDS, 0)  # where the next match of a kind may start
    runs = {"ip": 0, "card": 0}
    text = text or ""
    for last, (anchor, width) in anchors().iter(lowered(text)):
        at = last - width + 1
        if anchor == "digit":
            if at >= past["ip"] and at >= runs["ip"]:
                if m := _IP.match(text, at):
                    past["ip"] = m.end()
                    if all(len(x) <= 3 and int(x or 0) <= 255 for x in (g.lstrip("0") for g in m.groups())):
                        found["ip"].append(m.span())
                else:  # no part of this run of digits can start one either
                    end = at
                    while end < len(text) and "0" <= text[end] <= "9":
                        end += 1
                    runs["ip"] = end
            if at >= past["card"]:
                if m := _CARD.match(text, at):
                    past["card"] = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(m.span())
        elif anchor == "plus":
            if at >= past["phone"] and (m := _PHONE.match(text, at)):
                past["phone"] = m.end()
                if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found["phone"].append(m.span())
        elif anchor == "at":
            start = at
            while start > past["email"] and _LOCAL.match(text[start - 1]):
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at)):
                past["email"] = m.end()
                found["email"].append((start, m.end()))
        elif anchor == "scheme":
            if at >= past["url_login"] and (m := _LOGIN.match(text, at)):
                past["url_login"] = m.end()
                found["url_login"].append((at + 3, m.end() - 1))
        elif anchor == "credential":
            span = secret(text, last + 1)
            if span is None and text[at : last + 1].lower() == "bearer" and (m := _BEARER.match(text, last + 1)):
                span = m.span(1)
            if span and span[0] >= past["credential"]:
                past["credential"] = span[1]
                found["credential"].append(span)
        elif anchor in _TOKENS:
            if at >= past["credential"] and (m := _TOKENS[anchor].match(text, at)):
                past["credential"] = m.end()
                found["credential"].append(m.span())
        elif not text[at - 1 : at].isalnum() and (span := account(text, last + 1, ACCOUNT_CUES[anchor])) and span[0] >= past["account"]:
            past["account"] = span[1]
            found["account"].append(span)
    return [(k, a, b) for k in KINDS for a, b in sorted(found[k])]


def _find(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in spans(t)] for t in texts])


def _redact(texts: pa.Array) -> pa.Array:
    return by_parts(lambda part: pa.array([redact(t) for t in part], pa.string()), texts)


def redact(text: str | None) -> str | None:
    """The text with each span replaced by ``<kind>``; where spans of several kinds overlap, their union by the first's."""
    found = sorted((a, b, k) for k, a, b in spans(text))
    if not found:
        return text
    out, past = [], 0
    for a, b, kind in found:
        if a >= past:
            out += [text[past:a], f"<{kind}>"]
        past = max(past, b)
    return "".join([*out, text[past:]])


def find_pii(text: Column) -> Column:
    """Array of (kind, start, end) of a text column; empty for null or empty texts."""
    return F.pandas_udf(_find, SPANS)(text.cast("string"))


def redact_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind, and ``n_chars`` (if there) counted anew; null stays null."""
    out = docs.withColumn("text", F.arrow_udf(_redact, "string")(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
