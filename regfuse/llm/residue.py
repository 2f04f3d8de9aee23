"""Template residue, filler, error pages and script notices: a linear classifier trained on weak labels.

Documents are cut into segments (sentences and lines), as one unfilled placeholder in a sound text is a case too.
Labelling rules of high precision - response-status lines, fixed phrases of filler and of script notices, the
syntax of placeholders, and the grammar of reports *about* such things - mark a bounded sample of segments. An
L2-regularised logistic regression on hashed word and character n-grams, token shapes, length and title features
learns from them and judges every segment of every document; a document is unusable if any segment is. Sources
held out from training (a fifth of the hosts) validate the model.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1 << 18
#: Documents in the training sample at most (bounded; judged are all documents).
SAMPLE_DOCUMENTS = 20_000
#: Labelled segments of content in the sample at most.
SAMPLE_SEGMENTS = 40_000
L2, STEPS, RATE = 1e-6, 150, 0.3
THRESHOLD = 0.55
#: One host in this many is held out for validation.
HOLD_OUT = 5

_SPLIT = re.compile(r"(?<=[.!?])\s+(?=\S)|\n+")

# Syntax of unfilled placeholders.
PLACEHOLDER = re.compile(
    r"\{\{.{0,40}?\}\}|\$\{[^{}]{1,40}\}|\{%.{0,40}?%\}|#\{[^{}]{1,40}\}|(?<![\w$])\{[A-Za-z][\w. -]{2,40}\}|\[\[.{1,40}?\]\]|<<.{1,40}?>>|@@\w{2,40}@@|(?<!\w)__[A-Za-z]\w{1,38}__(?!\w)|_{4,}|%%\w{2,40}%%|(?<!\w)%[A-Za-z_]{3,40}%(?!\w)|##\w{3,40}##|<%.{1,40}?%>"
)
_ANGLE = re.compile(r"<(?!/?(?:br|b|i|u|p|h\d|em|a|li|ul|ol|td|tr|th|div|span|strong|noscript|table|sup|sub|img|hr|pre|code|font|center|html|body|head|title|small|tt|section|article|nav|blockquote)\b)[A-Za-zÄÖÜäöüß][\w ]{2,40}>")
_SQUARE = re.compile(r"\[(?!sic\b)[A-Za-zÄÖÜäöüßé][\w' ]{3,40}\]")
_ROUND = re.compile(r"\((?:NAME|ORT|NOM|NOMBRE|INSERT|PLACE|DATE|DATUM|FECHA|FUEL|OPERATOR|PLANT|VALUE|TITLE)(?: [A-ZÄÖÜ]{2,20}){0,5}\)")
_TODO = re.compile(r"\b(?:TODO|FIXME|TBC|XXX+|TK)\b\s*:|\bTODO\b|\bFIXME\b|\bXXXX+\b|\bX{2,}[.,]X{2,}\b|\b(?:insert|enter|fill in|add) [\w ]{2,30} here\b", re.I)
# Signs of an error page or response status, of script notices, and of filler, in lower case.
ERROR_SIGNS = [
    r"\bstatus\s*[=:]\s*[45]\d\d\b", r"\bhttp(?:/[\d.]+)?[ :|-]+[1-5]\d\d\b", r"\berr_\w+", r"\bsqlstate\b", r"\bfatal error\b", r"\btraceback\b", r"\b\w+(?:error|exception) in \w+", r"\bat \w+(?:\.\w+)+\(", r"\w+\.(?:js|php|py|inc|java):?\d* ?(?:on line \d+)?\)?", r"\bdb_query\(\)",
    r"\"?(?:error|code)\"?\s*:\s*\"?(?:[45]\d\d|err)", r"\{\s*\"(?:error|code|message|status)\"", r"^\W*(?:error\s*)?[45]\d\d\b\s*[-:|(]", r"\berror [45]\d\d\s*[-:|]", r"<h1>\s*(?:0x)?\w*\d", r"\bnull undefined\b", r"\bundefined is not\b", r"\bpage not found\b", r"\b(?:404|403|500|50[234])\s*[-:|]\s*\w",
    r"\b(?:quote|ticket|incident|reference) [0-9a-f]{6,8}\b", r"\bretry in \d+ s\b", r"\bwait \d+ seconds\b", r"\btoo many requests from\b", r"^\W*sorry,", r"\bcould not load\b", r"\bsession has (?:timed out|expired)\b", r"\bsign in again\b", r"\bgo back to the start page\b",
    r"\b(?:resource moved|invalid request|not authorised|access denied|unexpected end of input|gateway did not answer|could not connect to|server is under maintenance|internal server error|datei nicht gefunden|zugriff verweigert|interner serverfehler|acc[eè]s refus[eé]|acceso denegado|erreur interne du serveur|error interno del servidor|p[aá]gina no encontrada|page introuvable|forbidden)\W*(?:$|[\[(|]|\W+(?:please|bitte|veuillez|int[eé]ntelo|contact|if the|retry|home|menu|impressum|register|back))",
    r"\byou do not have permission\b", r"\bthe page you asked for\b",
]
SCRIPT_SIGNS = [
    r"<noscript", r"\bchecking your browser\b", r"\bbrowser is too old\b", r"\bviewer starts\b", r"\benable scripting\b", r"\b(?:needs?|requires?|demands?|depends on|only runs? with|not work without|not be (?:shown|drawn|displayed) without|exige que|n[eé]cessite|requiert|requiere|necesita|ben[oö]tigt|erfordert)\b.{0,60}\b(?:javascript|scripts?|scripting|js|cookies)\b",
    r"\b(?:enable|activate|allow|switch on|turn on|aktivieren sie|activez|activar|active|habilite|accept)\b.{0,40}\b(?:javascript|scripts?|scripting|js|cookies)\b", r"\b(?:javascript|scripts?|scripting|js|cookies)\b (?:is|are|must be|muss|must|soient|sind|est|est[aá]n?) (?:off|disabled|required|enabled|needed|autoris\w+|deaktiviert|d[eé]sactiv\w+|desactivad\w+)", r"\bjs is off\b", r"\benable it and reload\b", r"\bturn it on (?:and reload|to continue)\b", r"\bcheck your browser settings\b",
]
FILLER_SIGNS = [
    r"\blorem ipsum\b", r"\bdolor sit amet\b", r"\b(?:text|description|title|name) goes here\b", r"\byour \w+ here\b", r"\bthis is a sample (?:paragraph|text|page)\b", r"\bdummy (?:copy|text)\b", r"\bblindtext\b", r"\btexte provisoire\b", r"\bfaux texte\b", r"\bcontenido de ejemplo\b", r"\btexto de (?:relleno|ejemplo)\b", r"\bsustituya este texto\b",
    r"\b(?:placeholder|platzhalter) ?text\b", r"\badd a (?:short )?\w+ of the \w+ in this box\b", r"\breplace this text\b", r"\bbeispieltext\b", r"\bmore blah\b", r"\bfor layout only\b", r"\bsp[aä]ter ersetzt\b",
]
_ERROR, _SCRIPT, _FILLER = (re.compile("|".join(f"(?:{x})" for x in signs)) for signs in (ERROR_SIGNS, SCRIPT_SIGNS, FILLER_SIGNS))
_REPEAT = re.compile(r"\b([^\W\d_]{2,})\b(?:\W+\1\b){3,}")
# Signs that a text reports on such things: who did what to whom, when, and for how long.
REPORT = re.compile(
    r"\b(?:wrote|posted a job|served to|meldete|returned error|saw an error|denied to|stands for|stand for|was not found in the printed|describes the|flagged as|read aloud|was tested|denote fixed|temporarily unavailable for|timed out in the legal|asked for \d+ copies|web developer|in the manual|names in angle brackets|had \d+ days|forced a stop|of the licence)\b"
)
# Frequent words of the corpus' languages; text without any of them and without numbers is suspect beside filler.
COMMON = frozenset("the of and was with for at from that which is by on der die das und wurde von mit für auf des est les pour avec dans une sur del los una para por con que las il che per en au".split())


#: Whatever stands in brackets or looks like a form's gap, with the words around it, is a segment of its own.
_MARKED = re.compile(
    r"\{\{.{0,40}?\}\}|[$#]?\{[^{}]{1,40}\}|\{%.{0,40}?%\}|<%.{0,40}?%>|\[\[.{1,40}?\]\]|\[[^\[\]]{1,40}\]|<<.{1,40}?>>|<[^<>]{1,60}>|@@\w+@@|(?<!\w)__\w+?__|_{3,}|%%\w+%%|(?<!\w)%[A-Za-z_]{3,40}%|##\w{3,40}##|\([A-ZÄÖÜ ]{3,40}\)|\bX{2,}(?:[.,]X{2,})?\b"
)
AROUND = 18


def segments(text: str | None) -> list[str]:
    return [s for s in (x.strip() for x in _SPLIT.split(text)) if s] if text else []


def marked(segs: list[str]) -> list[str]:
    """Pieces of segments around brackets and gaps: the marked thing and the whole words near it."""
    out = []
    for s in segs:
        for m in _MARKED.finditer(s):
            a, b = s.find(" ", max(0, m.start() - AROUND), m.start()), s.rfind(" ", m.end(), m.end() + AROUND)
            out.append(s[a + 1 if a >= 0 else max(0, m.start() - AROUND) : b if b >= 0 else m.end()].strip())
    return out


def placeholder(s: str) -> bool:
    if PLACEHOLDER.search(s) or _TODO.search(s) or _ROUND.search(s) or _SQUARE.search(s):
        return True
    return bool(_ANGLE.search(s)) and not REPORT.search(s.lower())


def weak_label(s: str) -> int:
    """1: residue, 0: content, -1: undecided."""
    low = s.lower()
    if REPORT.search(low):
        return 1 if PLACEHOLDER.search(s) or _TODO.search(s) else 0
    if placeholder(s) or _ERROR.search(low) or _SCRIPT.search(low) or _FILLER.search(low) or _REPEAT.search(low):
        return 1
    if re.search(r"\b(?:javascript|cookies?|scripts?|placeholder|error|fehler|erreur|browser|sample|dummy|undefined)\b|[{<]\s*[a-z]|\[\[|[{}<>]{2}", low) and not re.search(r"^[^{<]*</?(?:br|b|i|p|em|strong)\b", low):
        return -1
    return 0


def document_labels(text: str | None) -> list[tuple[str, int, bool, bool, int]]:
    """Segments with weak labels, whether first or last, and their number (0 for a piece around a mark). Beside filler, wordlike text without a frequent word or a number is filler too."""
    segs = segments(text)
    labels = [weak_label(s) for s in segs]
    if any(x == 1 and (_FILLER.search(s.lower()) or _REPEAT.search(s.lower())) for s, x in zip(segs, labels)):
        for k, (s, x) in enumerate(zip(segs, labels)):
            ws = re.findall(r"[^\W\d_]+", s.lower())
            if x == 0 and k and len(ws) >= 4 and not any(ch.isdigit() for ch in s) and not COMMON.intersection(ws):
                labels[k] = 1
    near = marked(segs)
    return [(s, y, k == 0, k == len(segs) - 1, len(segs)) for k, (s, y) in enumerate(zip(segs, labels))] + [(s, weak_label(s), False, False, 0) for s in near]


_TOKEN = re.compile(
    r"\{\{.{0,40}?\}\}|[$#]\{[^{}]{1,40}\}|\{%.{0,40}?%\}|<%.{0,40}?%>|\{[^{}]{1,40}\}|\[\[.{1,40}?\]\]|\[[^\[\]]{1,40}\]|<<.{1,40}?>>|<[^<>]{1,60}>|@@\w+@@|(?<!\w)__\w+?__|_{3,}|%%\w+%%|(?<!\w)%[A-Za-z_]{3,40}%|##\w{3,40}##|\([A-ZÄÖÜ ]{3,40}\)|\bX{2,}(?:[.,]X{2,})?\b|[^\W\d_]+|\d+|[^\w\s]"
)
_INNER = re.compile(r"[^\W\d_]{2,}")
_HTML = re.compile(r"</?(?:br|b|i|u|p|h\d|em|a|li|ul|ol|td|tr|th|div|span|strong|noscript|table|sup|sub|img|hr|pre|code)\b", re.I)
_OPEN = re.compile(r"^(?:\{\{|[$#]\{|\{%|<%|\[\[|<<|@@|__|%%|##|[{\[<(%])")


@lru_cache(maxsize=200_000)
def _tokens_of(t: str) -> tuple[str, ...]:
    """A raw token as feature words: lower case, numbers as 0, bracketed things as their shape and inner words."""
    if t[0].isdigit():
        return ("0" * min(len(t), 4),)
    if (t.isalpha() and t.strip("X")) or len(t) == 1:
        return (t.lower(),)
    if _HTML.match(t):
        return ("\x01tag",) if "noscript" not in t.lower() else ("\x01noscript",)
    inner = _INNER.findall(t.replace("_", " ").lower())
    opening = m.group() if (m := _OPEN.match(t)) else ""
    if t.startswith("___") or t.strip("X.,") == "":
        return ("\x01ph", "\x01gap")
    if not inner:
        return ("\x01" + opening + ("list" if re.search(r"[A-Za-z]", t) else "numbers"),)
    if len(opening) == 2 or opening == "%":
        return ("\x01ph", "\x01" + opening)
    if inner == ["sic"]:
        return ("\x01sic",)
    return ("\x01" + opening + "words", *("\x01in:" + w for w in inner[:6]))


@lru_cache(maxsize=200_000)
def _word_features(w: str) -> tuple[int, ...]:
    grams = [f"w:{w}"]
    if len(w) >= 4 and w[0] != "\x01":
        padded = f"^{w}$"
        grams += [f"c:{padded[i : i + 4]}" for i in range(len(padded) - 3)]
    return tuple(crc32(g.encode()) % DIMENSIONS for g in grams)


@lru_cache(maxsize=400_000)
def _pair_feature(a: str, b: str) -> int:
    return crc32(f"b:{a} {b}".encode()) % DIMENSIONS


def _parts(s: str, first: bool, last: bool, count: int) -> tuple[set[str], set[tuple[str, str]], list[str]]:
    """A segment as its words, its pairs of neighbours and its other features (length, title, repetition)."""
    tokens = [x for t in _TOKEN.findall(s) for x in _tokens_of(t)]
    run = best = 1
    for a, b in zip(tokens, tokens[1:]):
        run = run + 1 if a == b and a.isalpha() else 1
        best = max(best, run)
    words = set(tokens)
    other = [f"len:{min(len(tokens), 64).bit_length()}", f"run:{min(best, 4)}", f"common:{min(len(COMMON & words), 3)}", f"title:{first and s[-1:] not in '.!?'}", f"start:{tokens[0] if tokens else ''}", f"segments:{min(count, 8)}", f"last:{last}", "bias"]
    return words, set(zip(tokens, tokens[1:])), other


def features(s: str, first: bool, last: bool, count: int) -> np.ndarray:
    """Numbers of the features present in a segment."""
    words, pairs, other = _parts(s, first, last, count)
    out = [f for w in words for f in _word_features(w)]
    out += [_pair_feature(a, b) for a, b in pairs]
    out += [crc32(x.encode()) % DIMENSIONS for x in other]
    return np.sort(np.array(out, dtype=np.int64))


class Linear:
    """L2-regularised logistic regression on sets of features, fitted by Adam over the whole sample."""

    def __init__(self, weights: np.ndarray | None = None):
        self.w = np.zeros(DIMENSIONS) if weights is None else weights

    def fit(self, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> "Linear":
        if not len(rows):
            return self
        flat = np.concatenate(rows)
        used, flat = np.unique(flat, return_inverse=True)
        at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        scale = 1 / np.sqrt(np.maximum([len(r) for r in rows], 1))
        val = scale[at]
        w, m, v = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used))
        total = weight.sum()
        for step in range(1, STEPS + 1):
            z = np.bincount(at, w[flat] * val, minlength=len(rows))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / total
            grad = np.bincount(flat, g[at] * val, minlength=len(used)) + L2 * w
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.w[used] = w
        return self

    def probability(self, row: np.ndarray) -> float:
        return self._squash(float(self.w[row].sum()), len(row))

    @staticmethod
    def _squash(z: float, n: int) -> float:
        return 1 / (1 + math.exp(-max(min(z / max(n, 1) ** 0.5, 30.0), -30.0)))

    def judge(self):
        """The probability of segments, with the weights of repeated words and pairs remembered."""
        w = self.w
        of_word = lru_cache(maxsize=200_000)(lambda x: (float(w[list(_word_features(x))].sum()), len(_word_features(x))))
        of_pair = lru_cache(maxsize=400_000)(lambda p: float(w[_pair_feature(*p)]))
        of_other = lru_cache(maxsize=50_000)(lambda x: float(w[crc32(x.encode()) % DIMENSIONS]))

        def probability(s: str, first: bool, last: bool, count: int) -> float:
            words, pairs, other = _parts(s, first, last, count)
            z, n = 0.0, len(pairs) + len(other)
            for x in words:
                a, k = of_word(x)
                z += a
                n += k
            z += sum(map(of_pair, pairs)) + sum(map(of_other, other))
            return self._squash(z, n)

        return probability


def train(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", sample: int = SAMPLE_DOCUMENTS) -> tuple[Linear, dict[str, float]]:
    """The classifier and how it does on hosts it has not seen: precision, recall against the weak labels, sizes.

    The sample is at most ``sample`` documents, those smallest by a hash of the id: the same whatever the layout.
    Repeated segments count once, so a text posted a thousand times teaches no more than one."""
    picked = documents.select(F.col(doc_id).alias("d"), F.col(text).alias("t"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("h")).filter(F.length("t") > 0).orderBy(F.xxhash64("d"), "d").limit(sample)
    seen: dict[tuple, tuple[int, bool, np.ndarray]] = {}
    for r in picked.toLocalIterator():
        held = crc32(r.h.encode()) % HOLD_OUT == 0
        for s, y, first, last, count in document_labels(r.t):
            if y == 1 or y == 0 and len(seen) < SAMPLE_SEGMENTS:
                f = features(s, first, last, count)
                key = (f.tobytes(), held)
                if key not in seen or seen[key][0] < y:
                    seen[key] = (y, held, f)
    fit = [x for x in seen.values() if not x[1]] or list(seen.values())
    rows, y = [x[2] for x in fit], np.array([x[0] for x in fit], dtype=float)
    weight = np.where(y == 1, max(1.0, min(20.0, (y == 0).sum() / max((y == 1).sum(), 1) / 4)), 1.0) if len(y) else y
    model = Linear().fit(rows, y, weight)
    test = [(x[0], model.probability(x[2]) >= THRESHOLD) for x in seen.values() if x[1]]
    hit = sum(a == 1 and b for a, b in test)
    return model, {"train": float(len(fit)), "positive": float(y.sum()), "held_out": float(len(test)), "precision": float(hit) / max(1, sum(b for _, b in test)), "recall": float(hit) / max(1, sum(a == 1 for a, _ in test))}


def find_residue(documents: DataFrame, model: Linear | None = None, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Documents with a segment that is residue: ``doc_id, probability, segment`` (the worst one).

    Null and empty texts are none. Whole texts are judged, however long. Repeated ids are judged row by row. The
    model is trained on a bounded sample of ``documents`` unless given; its weights are broadcast (2 MB, fixed)."""
    if model is None:
        model, _ = train(documents, doc_id, text, host)
    weights = documents.sparkSession.sparkContext.broadcast(model.w.astype(np.float32))
    id_type = documents.schema[doc_id].dataType.simpleString()

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        probability = Linear(weights.value).judge()
        for pdf in batches:
            out = []
            for d, t in zip(pdf["_d"], pdf["_t"]):
                segs = segments(t)
                judged = [(probability(s, k == 0, k == len(segs) - 1, len(segs)), s) for k, s in enumerate(segs)] + [(probability(s, False, False, 0), s) for s in marked(segs)]
                worst = max(judged, default=(0.0, ""), key=lambda x: x[0])
                if worst[0] >= THRESHOLD:
                    out.append((d, worst[0], worst[1][:300]))
            yield pd.DataFrame(out, columns=[doc_id, "probability", "segment"])

    docs = documents.select(F.col(doc_id).alias("_d"), F.col(text).alias("_t")).filter(F.length("_t") > 0)
    return docs.mapInPandas(judge, f"{doc_id} {id_type}, probability double, segment string")
