"""Several values packed in one field: dictionary-guided segmentation into one row per value.

The dictionary holds the known *whole* values in the bounded form of value shapes: every capital letter and digit
becomes ``X`` (``NR-2466886329`` is ``XX-XXXXXXXXXX``), so a shape stands for all values written that way. Shapes
are counted over all rows; those of fields that hold one value make the dictionary. A multi-pattern automaton
finds every dictionary entry in a field's shape, and dynamic programming picks the cheapest cover of the whole
field by known values, quoted values, delimiters and, at a price, unknown text. Blanks, slashes, colons, hyphens
or dots inside a known value are thereby no delimiters; inside quotes nothing is.

Segmentation depends on the shape only, so Python sees shapes of the few percent of fields that are not a plain
dictionary entry, each distinct one once a worker; the values are cut from the text in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of a field's rows a shape needs to be a dictionary candidate, and the least number of rows.
MIN_SHARE, MIN_ROWS = 0.0005, 2

HARD = ",;|\n\r\t"
QUOTES = "\"'`“”„‘’«»"
CLOSING = {'"': '"', "'": "'", "`": "`", "“": "”", "„": "“”", "‘": "’", "«": "»", "»": "«", "”": "”", "’": "’"}
BRACKETS = "[](){}<>"
# Words and signs that join two values when blanks stand around them.
JOINING = ["und", "and", "et", "y", "e", "ed", "og", "och", "i", "oder", "or", "ou", "en", "plus", "/", "+", "&", "//", "-"]
_SOFT = re.compile(r"\s+(?:" + "|".join(map(re.escape, JOINING)) + r")\s+", re.I)


def shape(c: str | Column) -> Column:
    """The shape of a text: capital ASCII letters and digits become X; its length in characters stays."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, "[A-Z0-9]", "X")


def _plain(s: str) -> str:
    """A shape without enclosing blanks, brackets, quotes and stray delimiters."""
    return s.strip(" " + HARD + QUOTES + BRACKETS)


def _skip(text: str, i: int) -> int:
    while i < len(text) and (text[i].isspace() or text[i] in HARD or text[i] in BRACKETS):
        i += 1
    return i


class Segmenter:
    """Cuts shapes into values; ``known`` are the dictionary's shapes."""

    def __init__(self, known: list[str]):
        import ahocorasick

        self.known = sorted(set(known))
        self.automaton = None
        if self.known:
            self.automaton = ahocorasick.Automaton()
            for k in self.known:
                self.automaton.add_word(k, len(k))
            self.automaton.make_automaton()
        self.spans = lru_cache(maxsize=200_000)(self._spans)

    def _known_at(self, text: str) -> dict[int, list[int]]:
        found: dict[int, list[int]] = {}
        if self.automaton is not None:
            for end, length in self.automaton.iter(text):
                a, b = end - length + 1, end + 1
                if (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum()):
                    found.setdefault(a, []).append(b)
        return found

    def _spans(self, text: str) -> list[tuple[int, int]]:
        n = len(text)
        known = self._known_at(text)
        # best[(i, free)]: cheapest way to reach i; free: a value may start here
        best: dict[tuple[int, bool], tuple[float, tuple | None, tuple[int, int] | None]] = {(0, True): (0.0, None, None)}

        def offer(frm, to, cost, span=None):
            c = best[frm][0] + cost
            if to not in best or c < best[to][0] - 1e-9:
                best[to] = (c, frm, span)

        for i in range(n):
            for free in (True, False):
                at = (i, free)
                if at not in best:
                    continue
                ch = text[i]
                soft = _SOFT.match(text, i)
                if soft:
                    offer(at, (soft.end(), True), 0.1)
                if ch.isspace() and ch not in HARD:
                    j = i
                    while j < n and text[j].isspace() and text[j] not in HARD:
                        j += 1
                    hard = j == n or i == 0 or text[j] in HARD or text[i - 1] in HARD
                    offer(at, (j, free), 0.0)
                    offer(at, (j, True), 0.0 if hard else 0.3)
                elif ch in HARD:
                    offer(at, (i + 1, True), 0.0)
                elif ch in BRACKETS:
                    offer(at, (i + 1, free), 0.01)
                elif ch in QUOTES:
                    offer(at, (i + 1, free), 0.5)
                if not free:
                    continue
                for j in known.get(i, ()):
                    offer(at, (j, False), 0.0, (i, j))
                if ch in QUOTES and (j := self._closing(text, i)) > i + 1 and text[i + 1 : j].strip():
                    offer(at, (j + 1, False), 0.2, (i + 1, j))
                if not (ch.isspace() or ch in HARD):
                    for j in self._unknown_ends(text, i):
                        offer(at, (j, False), 2 + 0.05 * (j - i), (i, j))
        end = min(((n, f) for f in (True, False) if (n, f) in best), key=lambda k: best[k][0])
        spans, at = [], end
        while at is not None:
            _, frm, span = best[at]
            if span:
                spans.append(span)
            at = frm
        return [s for s in (self._trim(text, *s) for s in reversed(spans)) if s]

    @staticmethod
    def _closing(text: str, i: int) -> int:
        """The end of the quotation that starts at i: the first closing quote before a delimiter, bracket or the end."""
        close, j = CLOSING[text[i]], i + 1
        while j < len(text):
            if text[j] in close:
                k = j + 1
                while k < len(text) and text[k] == " ":
                    k += 1
                if k == len(text) or text[k] in HARD or text[k] in BRACKETS or _SOFT.match(text, j + 1):
                    return j
            j += 1
        return -1

    @staticmethod
    def _unknown_ends(text: str, i: int) -> list[int]:
        """Where unknown text may end: at its first joining word or sign, and at its first delimiter."""
        j = i
        while j < len(text) and text[j] not in HARD:
            j += 1
        soft = _SOFT.search(text, i, j)
        return sorted({j, soft.start()} if soft and soft.start() > i else {j})

    @staticmethod
    def _trim(text: str, a: int, b: int) -> tuple[int, int] | None:
        drop = QUOTES + BRACKETS
        while a < b:
            if text[a].isspace():
                a += 1
            elif text[b - 1].isspace():
                b -= 1
            elif text[a] in drop and (text[b - 1] in drop) and b - a > 1:
                a, b = a + 1, b - 1
            elif text[a] in QUOTES or text[a] in "[{<" and not any(x in text[a:b] for x in "]}>"):
                a += 1
            elif text[b - 1] in QUOTES or text[b - 1] in "]}>" and not any(x in text[a:b] for x in "[{<"):
                b -= 1
            else:
                return a, b
        return None


def whole_values(counts: list[tuple[str, int]], rows: int, min_share: float = MIN_SHARE) -> list[str]:
    """The dictionary: shapes of whole values among (shape of a field, rows with it).

    A shape with delimiters, quotes or brackets inside is none; nor is one that shorter entries cover together."""
    support: dict[str, int] = {}
    for s, n in counts:
        p = _plain(s)
        if p and not any(ch in HARD or ch in QUOTES or ch in "[]{}" for ch in p):
            support[p] = support.get(p, 0) + n
    least = max(MIN_ROWS, min_share * rows)
    out: list[str] = []
    for s in sorted((s for s, n in support.items() if n >= least), key=lambda s: (len(s), s)):
        if out and len(Segmenter(out).spans(s)) > 1 and all(s[a:b] in out for a, b in Segmenter(out).spans(s)):
            continue
        if not any(ch == "X" for ch in s) and " " in s:
            continue
        out.append(s)
    return out


def fit_dictionary(df: DataFrame, fields: list[str], min_share: float = MIN_SHARE) -> dict[str, list[str]]:
    """Per field the shapes of its whole values, counted over all rows of ``df`` in one pass.

    Only shapes held by at least ``min_share`` of a field's rows reach the driver: at most 1/min_share a field."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.trim(shape(f)).alias("s")) for f in fields])).alias("x")).select("x.*")
    counted = long.filter(F.col("s").isNotNull() & (F.length("s") > 0)).groupBy("field", "s").agg(F.count(F.lit(1)).alias("n"))
    total = counted.groupBy("field").agg(F.sum("n").alias("rows"))
    kept = counted.join(F.broadcast(total), "field").filter((F.col("n") >= F.lit(min_share) * F.col("rows")) & (F.col("n") >= MIN_ROWS))
    found: dict[str, list[tuple[str, int]]] = {f: [] for f in fields}
    rows = dict.fromkeys(fields, 0)
    for r in kept.collect():
        found[r.field].append((r.s, r.n))
        rows[r.field] = r.rows
    return {f: whole_values(found[f], rows[f], min_share) for f in fields}


def split_packed(df: DataFrame, id_col: str, fields: list[str], dictionary: dict[str, list[str]] | None = None, only_multiple: bool = False) -> DataFrame:
    """One row per value of the packed ``fields``: ``id_col, field_name, pos, item_text``.

    Values come without enclosing blanks, quotes or brackets; pos counts non-empty values of a field from 1 and
    repeated values stay. Null, blank and delimiter-only fields give no row; an empty table gives none. Rows that
    repeat an id are split each by itself. ``only_multiple`` keeps fields with two or more values. Other columns of
    ``df`` are not read, so clashing names do no harm."""
    known = dictionary if dictionary is not None else fit_dictionary(df, fields)
    segmenters = {f: Segmenter(known.get(f, [])) for f in fields}

    def spans_of(field: str):
        seg_known = segmenters[field].known

        @F.pandas_udf("array<struct<a:int,n:int>>")
        def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            seg = Segmenter(seg_known)
            for s in batches:
                yield s.map(lambda t: [{"a": a + 1, "n": b - a} for a, b in seg.spans(t)] if t is not None else [])

        return spans

    parts = []
    for f in fields:
        plain = F.trim(F.col(f))
        single = shape(plain).isin(known[f]) if known.get(f) else F.lit(False)
        base = df.select(F.col(id_col), F.col(f).alias("_t")).filter(F.col("_t").isNotNull())
        # Arrow cannot carry what the filter drops: only fields that are no plain dictionary entry reach Python
        packed = base.filter(~shape(F.trim("_t")).isin(known[f]) if known.get(f) else F.lit(True)).filter(F.trim("_t") != "")
        cutup = packed.withColumn("_s", spans_of(f)(shape("_t"))).filter(F.size("_s") > (1 if only_multiple else 0))
        rows = cutup.select(id_col, F.lit(f).alias("field_name"), F.posexplode("_s").alias("_p", "_x"), "_t").select(
            id_col, "field_name", (F.col("_p") + 1).cast("bigint").alias("pos"), F.expr("substring(_t, _x.a, _x.n)").alias("item_text")
        )
        parts.append(rows)
        if not only_multiple:
            parts.append(df.filter(single & F.col(f).isNotNull()).select(id_col, F.lit(f).alias("field_name"), F.lit(1).cast("bigint").alias("pos"), plain.alias("item_text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
