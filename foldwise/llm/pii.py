"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass: at-signs, plus signs,
digits, URL schemes, identifier cues and cues of secrets.  Each anchor is handed to a small
deterministic parser that expands it to its boundaries and validates what it
finds; nothing else of the text is looked at.

Kinds: ``email``, ``ip``, ``card`` and ``phone`` follow fixed grammars (leftmost,
not overlapping within a kind, no retry after a failed validation); ``url_user``
(credentials in a URL), ``iban`` and ``account`` (an identifier after a cue such
as ``ssn:``) and ``secret`` (the value assigned to a name such as ``token`` or
``api_key``, to its quotes or boundary, if its length and characters are those
of a credential) are added by the method.  Positions are code points, the end
exclusive.

Defined cases: null and empty texts have no spans; texts are searched whole;
repeated rows get equal spans; extra columns pass through (columns named like
a result are replaced).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.common import require

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url_user", "iban", "account", "secret")
CUES = ("ssn", "iban", "account", "acct", "passport", "konto", "cuenta", "compte")
SECRET_CUES = ("token", "secret", "password", "passwd", "pwd", "api key", "api_key", "api-key", "apikey", "access key", "access_key",
               "access-key", "private key", "private_key", "private-key", "credential", "bearer")
SLICE_ROWS = 512

# the parsers' grammars, applied at one place each
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_USER = re.compile(r"://[^\s/@:?#]+:[^\s/@?#]+@[^\s/?#@]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_AFTER_CUE = re.compile(r"(?:\x20?(?:no|number|nr|num|code))?\.?\x20?[:#=]?\x20?([A-Z]{0,3}[0-9][0-9-]{5,}[0-9])(?![A-Za-z0-9])", re.I)
_VALUE = re.compile(r"""["']?\s{0,3}(?:=>|:=|[:=])\s{0,3}(?:bearer\x20+)?(?:(["'`])([^\s"'`]+)\1|([^\s"'`,;()<>\[\]{}]+))""", re.I)
_BEARER = re.compile(r"\x20+()()([A-Za-z0-9._~+/=-]+)")


def looks_secret(value: str, quoted: bool) -> bool:
    """Whether a value is as long and as varied as a credential: letters and digits among at least 12 characters
    (8 in quotes), six different ones."""
    if len(value) < (8 if quoted else 12) or len(set(value)) < 6:
        return False
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def luhn(digits: str) -> bool:
    """Whether the check digit of a number fits."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _byte_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def automaton():
    import ahocorasick
    a = ahocorasick.Automaton()
    for key, what in [("@", "email"), ("+", "phone"), ("://", "url"), *((d, "digit") for d in "0123456789")]:
        a.add_word(key, (what, len(key)))
    for cue in CUES:
        for form in (cue, cue.upper(), cue.capitalize()):
            a.add_word(form, ("cue", len(form)))
    for cue in SECRET_CUES:
        for form in (cue, cue.upper(), cue.capitalize(), cue.title()):
            a.add_word(form, ("bearer" if cue == "bearer" else "secret", len(form)))
    a.make_automaton()
    return a


def find(text: str, anchors) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of a text by start, then kind as listed in ``KINDS``."""
    spans: list[tuple[str, int, int]] = []
    email_end = phone_end = dotted_end = digits_end = user_end = account_end = secret_end = 0
    for last, (what, n) in anchors.iter(text):
        at = last - n + 1
        if what == "digit":
            if at >= dotted_end:      # the first digit of a run of numbers and dots
                m = _DOTTED.match(text, at)
                dotted_end = m.end()
                if "." in m[0]:
                    parts, start = m[0].split("."), at
                    for i in range(0, len(parts) - 3, 4):   # every four parts are one match
                        four = parts[i:i + 4]
                        end = start + sum(map(len, four)) + 3
                        if all(map(_byte_part, four)):
                            spans.append(("ip", start, end))
                        start = end + 1
            if at >= digits_end:      # the first digit of a run of digits with single separators
                m = _DIGITS.match(text, at)
                digits_end = m.end()
                if m.end() - at >= 14:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        spans.append(("card", at, m.end()))
        elif what == "email":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and at >= email_end and (m := _DOMAIN.match(text, at + 1)):
                spans.append(("email", start, m.end()))
                email_end = m.end()
        elif what == "phone":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    spans.append(("phone", at, m.end()))
        elif what == "url":
            if at >= user_end and (m := _USER.match(text, at)):
                user_end = m.end()
                spans.append(("url_user", at + 3, text.index("@", at)))
        elif what in ("secret", "bearer"):
            if at >= secret_end and not (at and text[at - 1].isalnum()):
                m = (_BEARER if what == "bearer" else _VALUE).match(text, last + 1)
                if m:
                    group = 2 if m[2] else 3
                    value = m[group] if group == 2 else m[group].rstrip(".:!?")
                    if looks_secret(value, group == 2):
                        spans.append(("secret", m.start(group), m.start(group) + len(value)))
                        secret_end = m.end()
        elif at >= account_end and not (at and text[at - 1].isalnum()):
            after = last + 1
            m = _IBAN.match(text, after + len(text[after:after + 2]) - len(text[after:after + 2].lstrip(" :")))
            if m and iban_ok(m[0]):
                spans.append(("iban", m.start(), m.end()))
                account_end = m.end()
            elif m := _AFTER_CUE.match(text, after):
                spans.append(("account", m.start(1), m.end(1)))
                account_end = m.end()
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def mask(text: str, spans) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    merged: list[list] = []
    for kind, start, end in spans:
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]])


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                     T.StructField("end", T.LongType())])
_WORKER: dict = {}


def detect(df: DataFrame, text_col: str = "text", spans_col: str = "pii", masked_col: str | None = None) -> DataFrame:
    """Columns of ``df`` plus the spans of each text as an array of (kind, start, end)
    and, if asked for, the masked text (null stays null)."""
    import pyarrow as pa
    require(df, text_col)
    new = [c for c in (spans_col, masked_col) if c]
    keep = [c for c in df.columns if c not in new or c == text_col]
    src = df.select(*[df[c].alias(f"c_{i}") for i, c in enumerate(keep)])
    at = keep.index(text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        anchors = _WORKER.setdefault("anchors", None) or _WORKER.update(anchors=automaton()) or _WORKER["anchors"]
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(i, SLICE_ROWS)
                texts = part.column(at).to_pylist()
                found = [find(t, anchors) if t else [] for t in texts]
                cols = [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in f] for f in found], kind)]
                if masked_col:
                    cols.append(pa.array([mask(t, f) if f else t for t, f in zip(texts, found, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], [*part.schema.names, *[f"n_{k}" for k in range(len(cols))]])

    schema = T.StructType([*src.schema.fields, T.StructField("n_0", T.ArrayType(SPAN)),
                           *([T.StructField("n_1", T.StringType())] if masked_col else [])])
    done = src.mapInArrow(run, schema)
    return done.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(keep) if c not in new],
                       *[F.col(f"n_{k}").alias(c) for k, c in enumerate(new)])


def joined(spans, kinds=None):
    """``kind:start:end`` of the spans (of some kinds), comma-joined."""
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
