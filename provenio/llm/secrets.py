"""Secret scans: keyword automaton, anchored expressions near its hits, embedded checksums.

An Aho-Corasick automaton runs once over each whole text and proposes places; an
expression is tried only where a keyword was found, anchored there. Runs of hex
digits have no keyword, so every eighth character is looked at instead: a run of 32
holds at least four such places in a row. Spans of the further kinds count only when
what they embed proves them: a CRC-32 in base 62 (GitHub and npm tokens), a JSON
header that names its algorithm (JWT), or a matching end line (PEM).

Defined cases: a null text counts as empty and has no spans; rows that repeat give
the same spans each; an empty table gives an empty result; columns of the input other
than id and text are not looked at. Texts are scanned whole, whatever their length.
Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenio.llm.common import only

#: In the order in which kinds with the same start are listed.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"

WORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm", "eyj": "jwt", "-----begin ": "pem",
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else re.escape(c) for c in word)


ASSIGN = re.compile(
    "(?:" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "apikey", "api_key"))) + ")"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
HEX_SAMPLE = re.compile("[0-9a-f]{4,}")
GITHUB = re.compile("gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile("npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
RUN = re.compile("[A-Za-z0-9_-]+")
PEM = re.compile(r"-----BEGIN ((?:[A-Z]+ )*PRIVATE KEY)-----[A-Za-z0-9+/=\s]+-----END \1-----")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def base62_crc(body: str) -> str:
    """CRC-32 of body in base 62, six digits."""
    n, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return digits


def _jwt_header(part: str) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (binascii.Error, ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


_PROOF = {
    "assign": (ASSIGN, lambda m: len(m[1]) >= 8),
    "access": (ACCESS, lambda m: len(m[0]) >= 16),
    "github": (GITHUB, lambda m: base62_crc(m[1]) == m[2]),
    "npm": (NPM, lambda m: base62_crc(m[1]) == m[2]),
    "jwt": (JWT, lambda m: _jwt_header(m[1])),
    "pem": (PEM, lambda m: True),
}


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in WORDS.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def _lowered(text: str) -> str:
    """ASCII letters in lower case, every other character where it was."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_ASCII_LOWER)


def scan(text: str | None, automaton) -> list[tuple[str, int, int]]:
    """Spans of one text, by start and then by kind."""
    if not text:
        return []
    spans = []
    starts: dict[str, list[int]] = {}
    for end, (kind, n) in automaton.iter(_lowered(text)):
        starts.setdefault(kind, []).append(end - n + 1)
    for kind, places in starts.items():
        expression, proof = _PROOF[kind]
        done = 0  # leftmost matches that don't overlap: also those that fail the proof use up their text
        for at in sorted(places):
            if at < done:
                continue
            if m := expression.match(text, at):
                done = m.end()
                if proof(m):
                    spans.append((kind, at, done))
            elif kind == "jwt":  # every further start in this run fails as this one did
                done = RUN.match(text, at).end()
    done = 0
    for at in (8 * i for s in HEX_SAMPLE.finditer(text[::8]) for i in range(s.start(), s.end())):
        if at >= done:
            left = at
            while left and HEX.match(text, left - 1, left):
                left -= 1
            done = HEX.match(text, left).end()
            if done - left >= 32:
                spans.append(("hex", left, done))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _scan_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    automaton = _automaton()
    for texts in batches:
        yield pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in scan(t, automaton)] for t in texts])


def find_secrets(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """docs with an array of spans (kind, start, end) of each whole text."""
    return docs.withColumn(into, F.pandas_udf(_scan_all, SPANS)(F.col(f"`{text}`")))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(found: DataFrame, id_col: str = "doc_id", spans: str = "spans") -> DataFrame:
    """Counts and a digest of the base kinds, and all spans as text."""
    s = F.col(spans)
    base = F.filter(s, lambda x: x["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col(id_col), count("assign"), count("access"), count("hex"),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(s).alias("spans"),
    )


def cut_out(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with a note for each span, by start; spans that overlap are cut out as one, by the longest of the first start."""
    at, parts = 0, []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if end <= at:
            continue
        if start >= at:
            parts += [text[at:start], f"[{kind} removed]"]
        at = end
    return "".join([*parts, text[at:]])


def _redacted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The texts that have spans without them, null for the others."""
    automaton = _automaton()
    for texts in batches:
        yield pd.Series([cut_out(t, found) if (found := scan(t, automaton)) else None for t in texts], dtype=object)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span replaced by a note of its kind; texts without one are left as they are.

    One function finds the spans and cuts them out, and only the texts it changed come back from it: a second one would
    give each task a second Python worker, and executors keep all workers they once had, with what these hold.
    """
    own = F.col(f"`{text}`")
    cut = F.coalesce(F.pandas_udf(_redacted, "string")(own), own)
    return only(docs, *docs.columns).select(*[cut.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
