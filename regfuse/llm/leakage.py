"""Evaluation texts leaking into training text: spaced-seed hashing and substitution-tolerant verification.

A passage of a test item and a corpus document are sequences of normalised words. Fixed masks pick three words out
of at most five neighbours and ignore the others; the hash of the picked words is a seed. A region of twenty words
with a third of them altered keeps a seed with near certainty. Corpus seeds are filtered by a bit set of all test
seeds (of fixed size, whatever the corpus holds), joined with the test seeds, and for each document and item that
share enough seeds in one region a local alignment of words decides.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regfuse.session import Cut, maybe_broadcast

#: Offsets of the words a mask picks.
MASKS = [(0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 3, 4), (0, 2, 4)]
#: Seeds in one region that make a document and an item a candidate; a region is this many words of shift. A seed that
#: stands in several wordings counts 1 by their number: of 20-word windows with 6 words altered one in a thousand has under 2.
MIN_SEEDS, REGION = 2, 40
#: Words a passage may reach beyond its outermost seeds, more than its own length.
MARGIN = 10
#: A leak: at least so many words agree in order, over so many words of the passage, in such a share of them,
#: of which so many are words that at most two items use, or else with so much rarity in all (a word of one item counts 1,
#: a word of all items 0) and no other item that agrees better there.
MIN_MATCHES, MIN_SPAN, MIN_SHARE, MIN_RARE, MIN_SCORE = 11, 14, 0.5, 2, 2.4

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "в": "b", "к": "k", "м": "m", "н": "h", "т": "t", "ӏ": "l",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "β": "b", "η": "n", "ɑ": "a", "ɡ": "g", "ı": "i", "ł": "l", "ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d",
}
_MAP = str.maketrans(HOMOGLYPHS)
_HYPHEN = re.compile(r"(?<=\w)[-‐‑]\s*\n\s*(?=\w)")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,80}>|&nbsp;|&#?\w{1,8};")
_APOSTROPHE = re.compile(r"(?<=\w)['’ʼ](?=\w)")
_SPACED = re.compile(r"(?<!\w)(?:\w[    ]){3,}\w(?!\w)")
_PERCENT = re.compile(r"%[0-9a-f]{2}")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Normalised words: compatibility forms, case, accents, look-alike letters, markup, invisible characters and
    hyphenation at line ends make no difference."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(ch for ch in text if unicodedata.category(ch) not in ("Mn", "Cf")).lower().translate(_MAP)
    else:
        text = text.lower()
    if "\n" in text:
        text = _HYPHEN.sub("", text)
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    if "'" in text or "’" in text:
        text = _APOSTROPHE.sub("", text)
    if "%" in text and _PERCENT.search(text):
        text = unquote(text, errors="replace").lower()
    text = _SPACED.sub(lambda m: re.sub(r"\s", "", m.group()), text)
    return _WORD.findall(text)


_SENTENCE = re.compile(r"(?<=[.?!:])\s+|\n+")


def passages(items: list[tuple[int, str | None]]) -> dict[int, list[str]]:
    """Each item's own words: without what several items share (instructions, labels) and without its question.

    A sentence is shared if, with capitalised words and numbers blanked out, three items have it. One with
    two names or numbers that all of them have alike is no pattern, but a passage that stands under several
    items."""
    cut = {i: [s for s in _SENTENCE.split(t or "") if s.strip()] for i, t in items}
    blank = lambda s: " ".join(re.sub(r"(?<!^)\b[A-Z]\w*|\d+", "#", s).lower().split())
    seen: dict[str, set[int]] = {}
    wordings: dict[str, set[str]] = {}
    for i, ss in cut.items():
        for s in ss:
            seen.setdefault(blank(s), set()).add(i)
            wordings.setdefault(blank(s), set()).add(s.strip())
    copied = lambda b: b.count("#") >= 2 and len(wordings[b]) == 1
    least = 3
    out = {}
    for i, ss in cut.items():
        own = [s for s in ss if (len(seen[blank(s)]) < least or copied(blank(s))) and not s.rstrip().endswith(("?", ":")) and len(words(s)) > 3]
        out[i] = words(" ".join(own))
    return out


def _seeds(ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of a sequence of word numbers and their positions; number 0 (no test word) gives no seed."""
    out, at = [], []
    for k, mask in enumerate(MASKS):
        n = len(ids) - mask[-1]
        if n <= 0:
            continue
        a, b, c = (ids[m : m + n] for m in mask)
        ok = np.flatnonzero((a > 0) & (b > 0) & (c > 0))
        out.append(((a[ok] * base + b[ok]) * base + c[ok]) * len(MASKS) + k)
        at.append(ok)
    return (np.concatenate(out), np.concatenate(at)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _slot(seeds: np.ndarray, bits: int) -> np.ndarray:
    h = seeds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


#: Numbers of the score tables held at once.
CELLS = 4_000_000


def align_many(pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[int, int, int, float, int]]:
    """Best local alignments of (document, item, weight of the item's words): matches, span in the item, span in the
    document, weight of the matched words, first word in the document.

    A match counts 2, a substitution, insertion or omission costs 1. Pairs of like length are filled in together."""
    out: list[tuple[int, int, int, float, int]] = [(0, 0, 0, 0.0, 0)] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda q: (len(pairs[q][1]), len(pairs[q][0])))
    while order:
        m = len(pairs[order[-1]][1])
        n = max(len(pairs[q][0]) for q in order[-64:])
        size = max(1, min(len(order), 64, CELLS // ((n + 1) * (m + 1))))
        some, order = order[-size:], order[:-size]
        doc, item = np.zeros((size, n), np.int64), np.full((size, m), -1, np.int64)
        for k, q in enumerate(some):
            doc[k, : len(pairs[q][0])], item[k, : len(pairs[q][1])] = pairs[q][0], pairs[q][1]
        score = np.zeros((size, n + 1, m + 1), np.int32)
        at = np.arange(1, m + 1, dtype=np.int32)
        for i in range(1, n + 1):
            word, before, row = doc[:, i - 1, None], score[:, i - 1], np.where((doc[:, i - 1, None] == item), np.int32(2), np.int32(-1))
            row[word[:, 0] == 0] = -1
            row += before[:, :-1]
            np.maximum(row, before[:, 1:] - 1, out=row)
            np.maximum(row, 0, out=row)
            # omissions of item words: a running maximum over the row
            row += at
            np.maximum.accumulate(row, axis=1, out=row)
            score[:, i, 1:] = np.maximum(row - at, 0)
        for k, q in enumerate(some):
            out[q] = _path(score[k], *pairs[q])
    return out


def _path(score: np.ndarray, doc: np.ndarray, item: np.ndarray, weight: np.ndarray) -> tuple[int, int, int, float, int]:
    """What the best alignment in a filled score table matches."""
    i, j = (int(x) for x in np.unravel_index(int(score.argmax()), score.shape))
    ei, ej, matches, total = i, j, 0, 0.0
    while i > 0 and j > 0 and score[i, j] > 0:
        equal = i <= len(doc) and j <= len(item) and doc[i - 1] > 0 and doc[i - 1] == item[j - 1]
        if score[i, j] == score[i - 1, j - 1] + (2 if equal else -1):
            if equal:
                matches += 1
                total += weight[j - 1]
            i, j = i - 1, j - 1
        elif score[i, j] == score[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return matches, ej - j, ei - i, float(total), i


def _windows(regions: list[tuple[int, int]], margin: int) -> list[tuple[int, int]]:
    """Regions, sorted, with a margin on both sides; those that overlap without one as a single window."""
    out: list[list[int]] = []
    for first, last in regions:
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(max(0, a - margin), b + margin + MASKS[-1][-1]) for a, b in out]


def is_leak(matches: int, span: int, doc_span: int, rares: int, score: float) -> bool:
    return matches >= MIN_MATCHES and span >= MIN_SPAN and matches >= MIN_SHARE * span and matches >= MIN_SHARE * doc_span and (rares >= MIN_RARE or score >= MIN_SCORE)


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Every document that holds about twenty or more words of an item's own passage, with the item and the evidence:
    ``doc_id, item_id, matches, span, doc_span``.

    The test set fits the driver (it is the fixed side; its size is what the caller holds out), the corpus is never
    collected: a document leaves its task only if it shares seeds with a test item, and then as word numbers. Null
    and empty texts leak nothing; repeated item rows count once; repeated documents are each reported once an id;
    items whose own passage is under 14 words can't be found. Other columns are not read."""
    spark = documents.sparkSession
    rows = {r[0]: r[1] for r in items.select(F.col(item_id), F.col(item_text)).filter(F.col(item_id).isNotNull()).toLocalIterator()}
    own = passages(sorted(rows.items()))
    vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for ws in own.values() for w in ws}))}
    base = len(vocabulary) + 1
    used: dict[int, int] = {}
    for ws in own.values():
        for w in set(ws):
            used[vocabulary[w]] = used.get(vocabulary[w], 0) + 1
    id_type = items.schema[item_id].dataType
    numbered = {i: np.array([vocabulary[w] for w in ws], dtype=np.int64) for i, ws in own.items() if len(ws) >= MIN_SPAN}
    placed = {i: _seeds(ids, base) for i, ids in numbered.items()}
    # at most one slot in 32 is taken, whatever the size of the test set
    bits_of = max(22, int(sum(len(x) for x, _ in placed.values()) * 32).bit_length())
    bits = np.zeros(1 << bits_of, dtype=bool)
    # the different wordings around a seed; copies of a passage under several items have the same
    around: dict[int, set[bytes]] = {}
    for i, (seeds, at) in placed.items():
        for k, p in zip(seeds.tolist(), at.tolist()):
            around.setdefault(k, set()).add(numbered[i][max(0, p - 2) : p + 7].tobytes())
    seed_rows: list[tuple] = []
    for i, (seeds, at) in placed.items():
        seed_rows += [(k, i, int(p), 1.0 / len(around[k])) for k, p in zip(seeds.tolist(), at)]
        bits[_slot(seeds, bits_of)] = True
    doc_type = documents.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", doc_type), T.StructField("item_id", id_type), T.StructField("matches", T.IntegerType()), T.StructField("span", T.IntegerType()), T.StructField("doc_span", T.IntegerType())])
    if not seed_rows:
        return spark.createDataFrame([], schema)
    packed = spark.sparkContext.broadcast(np.packbits(bits))
    words_of = spark.sparkContext.broadcast(vocabulary)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        has = np.unpackbits(packed.value).astype(bool)
        number = words_of.value.get
        for pdf in batches:
            out = []
            for d, t in zip(pdf["_d"], pdf["_t"]):
                ids = np.fromiter((number(w, 0) for w in words(t)), dtype=np.int64)
                seeds, at = _seeds(ids, base)
                hit = np.flatnonzero(has[_slot(seeds, bits_of)]) if len(seeds) else ()
                if len(hit) >= MIN_SEEDS:
                    out.append((d, ids.astype(np.int32), seeds[hit], at[hit].astype(np.int32)))
            yield pd.DataFrame(out, columns=["_d", "ids", "seeds", "at"])

    scan_schema = T.StructType([T.StructField("_d", doc_type), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("seeds", T.ArrayType(T.LongType())), T.StructField("at", T.ArrayType(T.IntegerType()))])
    docs = documents.select(F.col(doc_id).alias("_d"), F.col(text).alias("_t")).filter(F.col("_t").isNotNull() & (F.length("_t") > 0))
    found = Cut(docs.mapInPandas(scan, scan_schema), "seeds").df
    tests = spark.createDataFrame(pd.DataFrame(seed_rows, columns=["seed", "item_id", "p", "w"]), T.StructType([T.StructField("seed", T.LongType()), T.StructField("item_id", id_type), T.StructField("p", T.IntegerType()), T.StructField("w", T.DoubleType())]))
    hits = found.select("_d", F.explode(F.arrays_zip("seeds", "at")).alias("x")).select("_d", F.col("x.seeds").alias("seed"), F.col("x.at").alias("at"))
    joined = hits.join(maybe_broadcast(tests, len(seed_rows)), "seed").withColumn("shift", F.floor((F.col("at") - F.col("p")) / REGION))
    # a region at the border of two shifts counts for both
    regions = joined.select("_d", "item_id", F.explode(F.array("shift", F.col("shift") + 1)).alias("shift"), "at", "w")
    near = regions.groupBy("_d", "item_id", "shift").agg(F.sum("w").alias("n"), F.min("at").alias("first"), F.max("at").alias("last")).filter(F.col("n") >= MIN_SEEDS - 1e-9)
    near = near.groupBy("_d", "item_id").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("regions"))
    # a rare word's weight has a whole part of 1000 besides its rarity: both sums come out of one alignment
    rarity = {k: 1 - math.log(n) / math.log(1 + len(own)) + 1000 * (n <= 2) for k, n in used.items()}
    table_of = {i: (ids, np.array([rarity[int(k)] for k in ids])) for i, ids in numbered.items()}
    verified = T.StructType([*schema.fields, T.StructField("rare", T.BooleanType()), T.StructField("start", T.IntegerType())])
    all_items = spark.sparkContext.broadcast(table_of)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            who, pairs = [], []
            for d, i, regions, ids in zip(pdf["_d"], pdf["item_id"], pdf["regions"], pdf["ids"]):
                item, weight = all_items.value[i]
                ids = np.asarray(ids, dtype=np.int64)
                for a, b in _windows([(r["first"], r["last"]) for r in regions], len(item) + MARGIN):
                    rares, score = divmod(float(weight[np.isin(item, ids[a:b])].sum()), 1000)
                    # the passage's words in the window bound what an alignment can find
                    if rares >= MIN_RARE or score >= MIN_SCORE:
                        who.append((d, i, a))
                        pairs.append((ids[a:b], item, weight))
            out = []
            for (d, i, a), (matches, span, doc_span, total, start) in zip(who, align_many(pairs)):
                rares, score = divmod(total, 1000)
                if is_leak(matches, span, doc_span, rares, score):
                    out.append((d, i, matches, span, doc_span, rares >= MIN_RARE, a + start))
            yield pd.DataFrame(out, columns=[f.name for f in verified])

    good = Cut(near.join(found.select("_d", "ids"), "_d").select("_d", "item_id", "regions", "ids").mapInPandas(verify, verified), "leaks").df
    # words of the test's own style agree with several items: without rare words the best one counts
    other = good.select(F.col("doc_id").alias("_d"), F.col("matches").alias("_m"), F.col("start").alias("_s"), F.col("doc_span").alias("_n"))
    beaten = (F.col("doc_id") == F.col("_d")) & (F.col("_m") > F.col("matches")) & (F.col("_s") < F.col("start") + F.col("doc_span")) & (F.col("start") < F.col("_s") + F.col("_n"))
    good = good.filter("rare").unionByName(good.filter("not rare").join(other, beaten, "left_anti"))
    best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct("matches", "span", "doc_span")).alias("x"))
    return best.select(F.col("doc_id").alias(doc_id), F.col("item_id"), "x.matches", "x.span", "x.doc_span")
