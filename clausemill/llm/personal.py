"""Problem 6: personal details inside free text, found and replaced by typed placeholders.

Method: a semi-Markov conditional random field. Candidate segments (spans of tokens of a bounded length that a
detail of their type could have) are scored as wholes, by their shape, their words and the words around them;
tokens outside segments score nothing. The model is trained by the likelihood of marked sentences, with the sum
over all segmentations from a forward and a backward pass over the same lattice, and a text is segmented by the
dynamic program that chooses boundaries and types together.

One statistic of the corpus enters: of each word, hashed into a table of fixed size, how often it is written with
a capital inside a sentence and how often in lower case, over all texts given. Training uses ``TRAINING_TEXTS``
texts drawn from the grammar of :mod:`personal_training` and no data.

Cases: a null text has no detail and stays null; an empty text stays empty; repeated rows give repeated rows;
nulls in other columns and extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import functools
import math
import random
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.personal_training import fold, training_texts

BUCKETS = 1 << 16
TRAINING_TEXTS = 2400
EPOCHS = 6
MAX_NAME = 9
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
#: Words a street's type is written as.
STREETS = frozenset("rua r avenida av travessa tv alameda al praca pca estrada rodovia rod largo viela".split())
#: The longer of them also with two neighbouring letters exchanged, by rule.
STREETS |= {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for w in STREETS if len(w) > 4 for i in range(len(w) - 1)}
LINKS = frozenset("de da do das dos e".split())
_AT = r"(?:@|\(\s*(?:arroba|at)\s*\)|\[\s*(?:arroba|at)\s*\]|\barroba\b)"
_DOT = r"(?:\.|\s*\(\s*ponto\s*\)\s*|\s*\[\s*(?:ponto|dot)\s*\]\s*|\s+ponto\s+|\s*\(\s*dot\s*\)\s*)"
EMAIL = re.compile(rf"(?<![\w.+\-])[\w.+\-]*\w(?:\s+ponto\s+[\w.+\-]*\w)*\s*{_AT}\s*[\w\-]+(?:{_DOT}[\w\-]+)+", re.IGNORECASE)
NUMBER = re.compile(r"(?:\+\d{1,3}[ ]?)?(?:\(\d{2,3}\)[ ]?)?\d+(?:[ .\-/]\d+)*(?:-?[Xx]\b)?")
GROUP = re.compile(r"(?:\+|\((?=\d{2,3}\)))?\d+")
CODE = re.compile(r"\b[A-Za-z]{3}[ \-]?\d[A-Za-z0-9]\d{2}\b|\b[A-Za-z]{2}\d{6}\b")
_PART = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
HOUSE = re.compile(rf"^((?:{_PART}\.?[ \n]+){{1,7}}?)?(?:{_PART})(?:[ ]*,[ \n]*|[ \n]+)(?:(?:n[.º°o]*|num\.?|número|numero)[ \n]*)?(\d{{1,5}})\b(?!\s*(?:h\b|h\d|dias|/|km))", re.IGNORECASE)
TAIL = re.compile(r"^(?:[ ]*,[ ]*(?:apto?\.?|apartamento|casa|bloco|sala|fundos)[ ]*\d*|[ ]*-[ ]*CEP[ ]*\d{5}-?\d{3})+", re.IGNORECASE)
QUARTER = re.compile(r"^[ ]*,[ ]*[^\W\d_]+(?:[ ][^\W\d_]+){0,5}(?=[ ]*[.,;\n]|[ ]*$)")

#: Start, end, type, features of the inside as (name, value), first and last token.
Segment = tuple[int, int, str, list[tuple[str, str]], int, int]
_DATE = re.compile(r"(?:0?[1-9]|[12]\d|3[01])[/.\-](?:0?[1-9]|1[0-2])[/.\-](?:19|20)\d\d")
_HOUR = re.compile(r"\d[hH]\d\d$")
_MAY_BE_EMAIL = re.compile(r"@|arroba|[\[(]\s*at\s*[\])]", re.IGNORECASE)


def bucket(word: str) -> tuple[int, int]:
    """A word's two places in the tables; of two counts the smaller is nearer the truth."""
    raw = word.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) % BUCKETS, BUCKETS + zlib.crc32(raw[::-1], 0x9E3779B9) % BUCKETS


class Lexicon:
    """Whether a folded word is usually written with a capital (1), without (-1), or hardly known (0)."""

    def __init__(self, capital: np.ndarray, lower: np.ndarray):
        self.capital, self.lower = np.minimum(capital, 1 << 30).astype(np.int32), np.minimum(lower, 1 << 30).astype(np.int32)

    def __call__(self, word: str) -> int:
        a, b = bucket(word)
        capital, lower = min(self.capital[a], self.capital[b]), min(self.lower[a], self.lower[b])
        total = int(capital) + int(lower)
        return 0 if total < 3 else 1 if capital > 0.6 * total else -1 if capital < 0.25 * total else 0


def case_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Per bucket: words with a capital inside a sentence, words in lower case; only texts of mixed case count."""
    capital, lower = np.zeros(2 * BUCKETS, dtype=np.int64), np.zeros(2 * BUCKETS, dtype=np.int64)
    memo: dict[str, tuple[int, int]] = {}
    for text in texts:
        if not text or text == text.lower() or text == text.upper():
            continue
        before = "."
        for token in TOKEN.findall(text):
            if token[0].isalpha() and len(token) > 1:
                at = memo.get(token)
                if at is None:
                    at = memo[token] = bucket(fold(token))
                if token[0].islower():
                    lower[at[0]] += 1
                    lower[at[1]] += 1
                elif before not in ".!?:" and not token.isupper():
                    capital[at[0]] += 1
                    capital[at[1]] += 1
            before = token
    return capital, lower


def _shape(text: str) -> str:
    return re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", text)).replace("  ", " ")


def candidates(text: str, lexicon: Callable[[str], int]) -> tuple[list[Segment], list[str]]:
    """Segments a detail could occupy, each with the features of its inside, and the folded tokens of the text."""
    found = [(m.start(), m.end(), m.group()) for m in TOKEN.finditer(text)]
    begins, ends = [t[0] for t in found], [t[1] for t in found]
    words = [fold(t[2]) for t in found]
    state = [lexicon(w) for w in words]
    plain_case = text == text.lower() or text == text.upper()
    out: list[Segment] = []

    def add(start: int, end: int, kind: str, features: list[tuple[str, str]]) -> None:
        # the first token that ends after the start, and the last that begins before the end
        out.append((start, end, kind, features, bisect.bisect_right(ends, start), bisect.bisect_left(begins, end) - 1))

    if _MAY_BE_EMAIL.search(text):
        for m in EMAIL.finditer(text):
            add(m.start(), m.end(), "email", [("at", str("@" in m.group()))])
            inner = re.search(r"\s+ponto\s+", m.group()[: re.search(_AT, m.group(), re.IGNORECASE).start()], re.IGNORECASE)
            if inner:
                add(m.start() + inner.end(), m.end(), "email", [("short", "")])
    for m in NUMBER.finditer(text):
        if m.end() - m.start() < 7:
            continue
        groups = [(g.start() + m.start(), g.end() + m.start()) for g in GROUP.finditer(m.group())]
        for a in range(len(groups)):
            for b in range(a, min(len(groups), a + 6)):
                start, end = groups[a][0], groups[b][1]
                if end < m.end() and b == len(groups) - 1 and m.group()[-1] in "xX":
                    end = m.end()
                said = text[start:end]
                n = sum(map(str.isdigit, said))
                if not 7 <= n <= 14:
                    continue
                lead, tail = text[max(0, start - 1) : start], text[end : end + 1]
                inside = [("shape", _shape(said)), ("n", str(n)), ("whole", str(a == 0 and b == len(groups) - 1)), ("lead", lead if lead in "./-,$" else ""), ("tail", tail if tail in "/-," else ""), ("digits", str(said.isdigit())), ("year", str(n == 13 and said[:2] == "20")), ("date", str(bool(_DATE.fullmatch(said)))), ("mobile", str(said.isdigit() and n == 11 and said[2] == "9"))]
                add(start, end, "phone", inside)
                add(start, end, "identity_number", inside)
    for m in CODE.finditer(text):
        shape = _shape(m.group())
        kind = "identity_number" if shape == "aa999999" else "plate"
        known = lexicon(fold(m.group()[:3])) if kind == "plate" else 0
        add(m.start(), m.end(), kind, [("shape", shape), ("upper", str(m.group().upper() == m.group())), ("known", str(known)), ("hour", str(bool(_HOUR.search(m.group()))))])
    for i, word in enumerate(words):
        start, end = begins[i], ends[i]
        if word in STREETS:
            after = end + (text[end : end + 1] == ".")
            gap = re.match(r"[ \n]+", text[after : after + 8])
            got = HOUSE.match(text[after + gap.end() : after + 400]) if gap else None
            if got:
                stop = after + gap.end() + got.end(2)
                link = text[after + gap.end() : after + gap.end() + got.start(2)].rstrip()
                lower = sum(lexicon(w) < 0 and w not in LINKS for w in map(fold, re.findall(r"[^\W\d_]+", link)))
                inside = [("type", word), ("comma", str(link.endswith(","))), ("mark", str(bool(re.search(r"(n[.º°o]*|numero|número|num)$", link, re.IGNORECASE)))), ("stops", str(lower))]
                add(start, stop, "street_address", inside)
                more = TAIL.match(text[stop : stop + 200])
                if more:
                    add(start, stop + more.end(), "street_address", [*inside, ("tail", "")])
                quarter = QUARTER.match(text[stop : stop + 200])
                if quarter:
                    said = [lexicon(fold(w)) for w in re.findall(r"[^\W\d_]+", quarter.group()) if fold(w) not in LINKS]
                    add(start, stop + quarter.end(), "street_address", [*inside, ("quarter", str(min(said, default=0)))])
            continue
        if state[i] < 0 or len(word) < 2 or not word[0].isalpha() or word in LINKS:
            continue
        opens = i == 0 or found[i - 1][2] in ".!?:" or "\n" in text[ends[i - 1] : start]
        near_street = any(words[k] in STREETS for k in range(max(0, i - 4), i))
        for j in range(i + 1, min(len(words), i + MAX_NAME)):
            between = text[ends[j - 1] : begins[j]]
            last = words[j]
            stop = text[ends[j] : ends[j] + 1]
            if between.strip(" \n") or between.count("\n") > 1 or not last[0].isalpha() or not between:
                break
            if last in LINKS and not (len(last) == 1 and stop == "." and (plain_case or text[begins[j]].isupper())):
                continue
            initial = len(last) == 1
            if initial and stop != "." and (plain_case or last in "aeo" or not text[begins[j]].isupper()):
                break
            inner = [state[k] for k in range(i, j + 1) if words[k] not in LINKS and len(words[k]) > 1]
            if not initial and min(inner) < 0:
                if state[j] < 0:
                    break
                continue
            caps = [text[begins[k]].isupper() for k in range(i, j + 1) if words[k] not in LINKS]
            form = "".join("e" if w == "e" else "d" if w in LINKS else "i" if len(w) == 1 else "w" for w in words[i : j + 1])
            inside = [("form", form), ("caps", "none" if plain_case else "all" if all(caps) else "some" if any(caps) else "no"), ("known", f"{min(inner, default=0)}{max(inner, default=0)}"), ("first", str(state[i])), ("street", str(near_street)), ("street+form", f"{near_street}{form}"), ("w0", word), ("opens", f"{opens}{state[i]}{sum(w not in LINKS for w in words[i : j + 1])}"), ("wrap", str("\n" in text[start : ends[j]]))]
            add(start, ends[j], "person_name", inside)
            if initial:
                k = j + 2  # a family name may follow the initial's full stop
                if k < len(words) and text[ends[j] : begins[k]] in (". ", ".\n") and words[k][0].isalpha() and state[k] >= 0 and len(words[k]) > 2:
                    add(start, ends[k], "person_name", [*inside, ("family", str(state[k])), ("familycase", str(text[begins[k]].isupper()))])
                break
    return out, words


def before(words: list[str], i: int) -> list[tuple[str, str]]:
    """Features of the words before token i."""
    one, two = (words[i - k] if i >= k else "^" for k in (1, 2))
    return [("p1", one), ("p2", two), ("p12", f"{two} {one}"), *(("near", w) for w in {words[k] if k >= 0 else "^" for k in range(i - 5, i)})]


def after(words: list[str], j: int) -> list[tuple[str, str]]:
    """Features of the word after token j, and the bias."""
    return [("n1", words[j + 1] if j + 1 < len(words) else "^"), ("bias", "")]


class SegmentModel:
    """Weights of segment features by type, name and value; tokens outside segments have score 0."""

    def __init__(self, weights: dict[str, dict[str, dict[str, float]]]):
        self.weights = weights

    def scores(self, segments: list[Segment], words: list[str]) -> list[float]:
        """Score of each segment; what its neighbourhood adds is summed once for each type and place."""
        left: dict[tuple[str, int], float] = {}
        right: dict[tuple[str, int], float] = {}
        out = []
        for _, _, kind, inside, i, j in segments:
            own = self.weights.get(kind)
            if own is None:
                out.append(0.0)
                continue
            a, b = left.get((kind, i)), right.get((kind, j))
            if a is None:
                a = left[kind, i] = self._sum(own, before(words, i))
            if b is None:
                b = right[kind, j] = self._sum(own, after(words, j))
            out.append(a + b + self._sum(own, inside))
        return out

    @staticmethod
    def _sum(own: dict[str, dict[str, float]], features: list[tuple[str, str]]) -> float:
        total = 0.0
        for name, value in features:
            of = own.get(name)
            if of is not None:
                total += of.get(value, 0.0)
        return total

    def best(self, segments: list[Segment], words: list[str]) -> list[Segment]:
        """The non-overlapping segments of the greatest total score."""
        if not segments:
            return []
        scored = sorted(((s[1], s[0], x, k) for k, (s, x) in enumerate(zip(segments, self.scores(segments, words))) if x > 0))
        ends, total, back = [0], [0.0], [(-1, -1)]
        for end, start, x, k in scored:
            at = bisect.bisect_right(ends, start) - 1
            if total[at] + x > total[-1]:
                if end == ends[-1] and len(ends) > 1:
                    total[-1], back[-1] = total[at] + x, (at, k)
                else:
                    ends.append(end)
                    total.append(total[at] + x)
                    back.append((at, k))
        out, at = [], len(ends) - 1
        while at > 0:
            at, k = back[at]
            out.append(segments[k])
        return out[::-1]


def _marginals(segments: list[Segment], scores: list[float]) -> list[float]:
    """Probability of each segment over all segmentations."""
    points = sorted({0, *(p for s in segments for p in s[:2])})
    place = {p: i for i, p in enumerate(points)}
    n = len(points)
    into: dict[int, list[int]] = defaultdict(list)
    out_of: dict[int, list[int]] = defaultdict(list)
    for k, s in enumerate(segments):
        into[place[s[1]]].append(k)
        out_of[place[s[0]]].append(k)
    alpha, beta = [0.0] * n, [0.0] * n

    def add(a: float, b: float) -> float:
        high, low = (a, b) if a > b else (b, a)
        return high + math.log1p(math.exp(low - high)) if low > -1e300 else high

    for i in range(1, n):
        alpha[i] = alpha[i - 1]
        for k in into[i]:
            alpha[i] = add(alpha[i], alpha[place[segments[k][0]]] + scores[k])
    for i in range(n - 2, -1, -1):
        beta[i] = beta[i + 1]
        for k in out_of[i]:
            beta[i] = add(beta[i], beta[place[segments[k][1]]] + scores[k])
    whole = alpha[-1] if n else 0.0
    return [math.exp(min(0.0, alpha[place[s[0]]] + x + beta[place[s[1]]] - whole)) for s, x in zip(segments, scores)]


@functools.lru_cache(maxsize=1)
def trained(seed: int = 5) -> SegmentModel:
    """The model, trained on texts of the grammar's training part by stochastic ascent of the likelihood."""
    texts, proper = training_texts(TRAINING_TEXTS)
    rng = random.Random(seed)
    counted = Lexicon(*case_counts([t for t, _ in texts]))
    known = {fold(w) for t, _ in texts for w in TOKEN.findall(t) if w[0].isalpha()}
    state = {w: 0 if rng.random() < 0.12 else 1 if w in proper else counted(w) for w in sorted(known)}
    lattices = []
    for text, spans in texts:
        segments, words = candidates(text, lambda w: state.get(w, 0))
        want = {(s, k): e for s, e, k in spans}
        longest: dict[tuple[int, str], int] = {}
        for s, e, k, *_ in segments:
            if (s, k) in want and e <= want[s, k] + 1:
                longest[s, k] = max(longest.get((s, k), 0), e)
        keys = [[(k, *f) for f in (*inside, *before(words, i), *after(words, j))] for _, _, k, inside, i, j in segments]
        lattices.append((segments, keys, [longest.get((s, k)) == e for s, e, k, *_ in segments]))
    weights: dict[tuple[str, str, str], float] = defaultdict(float)
    squares: dict[tuple[str, str, str], float] = defaultdict(float)
    for _ in range(EPOCHS):
        rng.shuffle(lattices)
        for segments, keys, gold in lattices:
            if not segments:
                continue
            chance = _marginals(segments, [sum(weights[f] for f in own) for own in keys])
            for own, g, p in zip(keys, gold, chance):
                step = g - p
                if abs(step) < 1e-3:
                    continue
                for f in own:
                    squares[f] += step * step
                    weights[f] += 0.25 * step / math.sqrt(squares[f] + 1e-6) - 1e-4 * weights[f]
    nested: dict[str, dict[str, dict[str, float]]] = {}
    for (kind, name, value), w in weights.items():
        if abs(w) > 1e-3:
            nested.setdefault(kind, {}).setdefault(name, {})[value] = w
    return SegmentModel(nested)


def details(text: str, model: SegmentModel, lexicon: Callable[[str], int]) -> list[tuple[int, int, str]]:
    return [s[:3] for s in model.best(*candidates(text, lexicon))]


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with ``[TYPE]`` for each detail."""
    out, at = [], 0
    for start, end, kind in sorted(found):
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def corpus_lexicon(texts: DataFrame, text_col: str) -> Lexicon:
    """Case statistics over all texts; at most twice BUCKETS rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        capital, lower = np.zeros(2 * BUCKETS, dtype=np.int64), np.zeros(2 * BUCKETS, dtype=np.int64)
        for batch in batches:
            a, b = case_counts(batch.column(0).to_pylist())
            capital += a
            lower += b
        at = np.flatnonzero(capital + lower)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(capital[at]), pa.array(lower[at])], names=["b", "c", "l"])

    counted = texts.select(text_col).mapInArrow(run, "b int, c bigint, l bigint").groupBy("b").agg(F.sum("c"), F.sum("l")).collect()
    capital, lower = np.zeros(2 * BUCKETS, dtype=np.int64), np.zeros(2 * BUCKETS, dtype=np.int64)
    for b, c, n in counted:
        capital[b], lower[b] = c, n
    return Lexicon(capital, lower)


def find_personal(texts: DataFrame, text_col: str, lexicon: Lexicon | None = None) -> DataFrame:
    """The input with ``details`` ARRAY<STRUCT<start_pos, end_pos, pii_type>> and ``redacted`` added.

    Columns of these names in the input are replaced.
    """
    texts = texts.drop(*({"details", "redacted"} - {text_col}))
    lexicon = lexicon or corpus_lexicon(texts, text_col)
    model = trained()
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((model.weights, lexicon.capital, lexicon.lower))  # features of the training texts; four BUCKETS of counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, capital, lower = shared.value
        own = SegmentModel(weights)
        known = functools.lru_cache(maxsize=100_000)(Lexicon(capital, lower).__call__)
        kind = pa.list_(pa.struct([("start_pos", pa.int64()), ("end_pos", pa.int64()), ("pii_type", pa.string())]))
        for batch in batches:
            every = batch.column(text_col).to_pylist()
            found = [details(t, own, known) if t else [] for t in every]
            rows = [[{"start_pos": s, "end_pos": e, "pii_type": k} for s, e, k in f] for f in found]
            clean = [None if t is None else redact(t, f) for t, f in zip(every, found)]
            yield batch.append_column("details", pa.array(rows, type=kind)).append_column("redacted", pa.array(clean, type=pa.string()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema) + ", details array<struct<start_pos:bigint,end_pos:bigint,pii_type:string>>, redacted string"
    return texts.mapInArrow(run, schema)
