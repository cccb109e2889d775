"""Secrets in texts: fixed shapes, and values in credential contexts that would cost an attacker too many guesses.

The cost of a value is that of its cheapest segmentation into dictionary words, dates, repeats, keyboard walks and
brute-force characters, found by dynamic programming over its ends. Placeholders such as `password123` come apart
into cheap pieces; random keys do not and are reported.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tableloom.llm.common import col

# The shapes of secrets, and the least length of what counts.
SHAPES = (
    ("assign", re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
KINDS = ("assign", "access", "hex", "guess")

CONTEXTS = (
    re.compile(
        r"(?ai)(?<![a-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret|auth)[_-]?key|client[_-]?secret|auth|credentials?|login)"
        r"[\"'`]?[ \t]*(?::=|=>|[:=])[ \t]*[\"'`]?(?P<value>[^\s\"'`<>,;]{6,})"),
    re.compile(r"(?ai)[a-z][a-z0-9+.-]{1,15}://[^\s/:@\"'<>]{1,64}:(?P<value>[^\s/@\"'<>]{6,})@"),
)
# Every context holds one of these, in lower case.
HINTS = (b"pass", b"pwd", b"secret", b"token", b"key", b"auth", b"credential", b"login", b"://")
LEAST_GUESSES = 8.0  # log10

# Words that guessers try first, by rank.
COMMON_WORDS = (
    "password passwd secret admin root user login welcome letmein master dragon monkey shadow sunshine princess football baseball superman "
    "batman trustno iloveyou hello freedom whatever access default changeme change example test testing guest demo sample token api key "
    "apikey none null true false undefined your my the here insert replace placeholder xxx foo bar baz qwerty abc pass word love money "
    "summer winter spring autumn monday friday january june july august october december server database mysql postgres oracle system "
    "public private internal production staging local home office company service account client manager support security network"
).split()
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("4301$5@7!", "aeolssati")
YEARS = 120
# Characters that are segmented at once.
SLICE = 1024

_DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:(?:19|20)\d\d|\d\d)|(?:19|20)\d\d)")
_WORD_LENGTH = 24


def _steps() -> dict[tuple[str, str], int]:
    """Direction of one step on a keyboard row or the alphabet, on shifted text alike."""
    out = {}
    for row in ROWS:
        for a, b in zip(row, row[1:]):
            out[a, b] = out.get((a, b), 1)
            out[b, a] = out.get((b, a), -1)
    for upper, lower in zip((ROWS[0][1:], *ROWS[1:3]), ROWS[1:4]):
        for a, b in zip(upper, lower):
            out[a, b], out[b, a] = 2, -2
    return out


_WALK = _steps()


def _char(ch: str) -> float:
    """log10 of the size of the class that a character comes from."""
    return math.log10(10 if ch.isdigit() else 26 if "a" <= ch.lower() <= "z" else 33 if ch.isascii() else 1000)


def _cases(text: str) -> float:
    upper = sum(c.isupper() for c in text)
    if not upper:
        return 0.0
    if upper == len(text) or (upper == 1 and text[0].isupper()):
        return math.log10(2)
    return math.log10(sum(math.comb(len(text), i) for i in range(1, min(upper, len(text) - upper) + 1)) + 1)


class Guesser:
    """Guess costs, as log10, under a ranked list of words."""

    def __init__(self, words: Iterable[str] = COMMON_WORDS):
        self.ranks: dict[str, int] = {}
        for word in words:
            self.ranks.setdefault(word.lower(), len(self.ranks) + 1)
        self.longest = min(_WORD_LENGTH, max(map(len, self.ranks), default=0))
        self.cost = lru_cache(maxsize=4096)(self._cost)

    def _word(self, text: str) -> float | None:
        low = text.lower()
        if rank := self.ranks.get(low):
            return math.log10(rank + 1) + _cases(text)
        plain = low.translate(LEET)
        if plain != low and (rank := self.ranks.get(plain)):
            return math.log10(rank + 1) + _cases(text) + math.log10(2) * sum(a != b for a, b in zip(low, plain))
        return None

    def _cost(self, text: str) -> float:
        """The cheapest segmentation of `text`; every further segment doubles the guesses."""
        n, low, more = len(text), text.lower(), math.log10(2)
        best = [0.0] + [math.inf] * n
        dates = [[] for _ in range(n + 1)]
        for at in range(n):
            for size in (4, 5, 6, 7, 8, 9, 10):
                if at + size <= n and (m := _DATE.fullmatch(text, at, at + size)):
                    year_only = size == 4 and text[at:at + 2] in ("19", "20")
                    dates[at + size].append((at, math.log10(YEARS if year_only else 365 * YEARS) + (more * 2 if m[1] or m[2] else 0)))
        walk_from, walk_turns = 0, 0
        for end in range(1, n + 1):
            found = best[end - 1] + _char(text[end - 1])
            for size in range(2, min(self.longest, end) + 1):
                if (c := self._word(text[end - size:end])) is not None:
                    found = min(found, best[end - size] + c + more)
            for at, c in dates[end]:
                found = min(found, best[at] + c + more)
            # The longest walk that ends here; a walk of three keys or more is cheaper than its keys.
            if end > 1 and (low[end - 2], low[end - 1]) in _WALK:
                step = _WALK[low[end - 2], low[end - 1]]
                if end - 1 - walk_from >= 2 and step != _WALK.get((low[end - 3], low[end - 2])):
                    walk_turns += 1
            else:
                walk_from, walk_turns = end - 1, 0
            if end - walk_from >= 3:
                c = math.log10(47 * (end - walk_from)) + walk_turns * math.log10(4.6) + _cases(text[walk_from:end])
                found = min(found, best[walk_from] + c + more)
            # A unit of up to 12 characters that has been said at least twice up to here.
            for unit in range(1, min(12, end // 2) + 1):
                times = 1
                while end - (times + 1) * unit >= 0 and text[end - (times + 1) * unit:end - times * unit] == text[end - unit:end]:
                    times += 1
                    if times * unit > 4096:
                        break
                if times > 1:
                    base = sum(map(_char, text[end - unit:end]))
                    if (c := self._word(text[end - unit:end])) is not None:
                        base = min(base, c)
                    found = min(found, best[end - unit * times] + base + math.log10(times) + more)
            best[end] = found
        return best[n]

    def reaches(self, text: str, least: float) -> bool:
        """Whether `text` costs 10^least guesses; a very long one is segmented slice by slice."""
        spent = 0.0
        for at in range(0, len(text), SLICE):
            spent += self.cost(text[at:at + SLICE])
            if spent >= least:
                return True
        return False


def shaped(text: str, kinds: Iterable[str] | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed shapes, leftmost and non-overlapping per kind; matches that are too short are dropped."""
    return [
        (kind, *m.span()) for kind, shape, group, least in SHAPES if kinds is None or kind in kinds
        for m in shape.finditer(text) if len(m[group]) >= least]


def guarded(text: str, base: list[tuple[str, int, int]], guesser: Guesser, least: float = LEAST_GUESSES) -> list[tuple[str, int, int]]:
    """Values in credential contexts that cost at least 10^least guesses and do not overlap a shaped secret."""
    out: list[tuple[str, int, int]] = []
    for context in CONTEXTS:
        for m in context.finditer(text):
            a, b = m.span("value")
            while b > a and text[b - 1] in ".:)]}!?":
                b -= 1
            if b - a >= 6 and not any(x < b and a < y for _, x, y in (*base, *out)) and guesser.reaches(text[a:b], least):
                out.append(("guess", a, b))
    return out


_HEX = bytes(49 if chr(b) in "0123456789abcdef" else 48 for b in range(256))


def secrets_of(text: bytes | None, guesser: Guesser, least: float = LEAST_GUESSES) -> list[tuple[str, int, int]]:
    """All spans of a text, by start and then by kind; cheap tests on the bytes say which patterns can match at all."""
    text = text or b""
    low = text.lower()
    hinted = any(h in low for h in HINTS)
    kinds = {"assign"} if hinted else set()
    if b"AKIA" in text:
        kinds.add("access")
    if b"1" * 24 in text.translate(_HEX):
        kinds.add("hex")
    if not kinds:
        return []
    whole = text.decode("utf-8", "replace")
    found = shaped(whole, kinds)
    if hinted:
        found += guarded(whole, found, guesser, least)
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def secret_spans(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: Iterable[str] = COMMON_WORDS, least_guesses: float = LEAST_GUESSES,
) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) per row: code points of the whole text, end exclusive, by start and kind.

    Null and empty texts have no spans. Rows are looked at one by one, so repeated rows and ids, null ids and other
    columns change nothing. An empty table gives none.
    """
    rows = df.select(col(id_col).alias("doc_id"), col(text_col).cast("binary").alias("text"))
    id_type, listed = rows.schema["doc_id"].dataType.simpleString(), list(words)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesser = Guesser(listed)
        for part in parts:
            found = [[dict(zip(("kind", "start", "end"), s)) for s in secrets_of(t, guesser, least_guesses)] for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(span))], ["doc_id", "spans"])

    return rows.mapInArrow(run, f"doc_id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(df: DataFrame, spans: Column, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """`df` with every span of its text replaced by `mask`; overlapping spans are one."""
    ends = F.aggregate(
        spans, F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(F.col(text_col), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mask)))
            .otherwise(acc["out"]).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), (acc["at"] + 1).cast("int"), F.lit(2147483647))))
    return df.withColumn(text_col, F.when(F.size(spans) > 0, ends).otherwise(F.col(text_col)))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
