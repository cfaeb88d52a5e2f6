"""Problem 5: repair of text that was read from scanned pages.

Method: a vocabulary is counted over the clean texts; it holds every word that they
hold at least ``SUPPORT`` times, equal texts counted once.
A token outside it is looked up by intersecting the Levenshtein automaton of the token with a trie of the
vocabulary, which finds every word within the distance; the candidates are ranked by how well known misreadings
explain them and by the words next to them. Running headers, footers and page numbers are removed, words broken at
line ends are joined unless the mark belongs to the word, and lines are reflowed into paragraphs.

The vocabulary stays distributed: it is split by first letter and length, and each different token of the scanned
texts goes to the parts that can hold a word it is a misreading of. Only the answers to these tokens come back,
broadcast up to ``BROADCAST_ROWS`` and joined by text beyond. The ``COMMON_WORDS`` most frequent words are broadcast
to spare their lookup; every other word of a text is among its answers. Neighbouring pairs of words rank candidates by
context and tell wording from running lines: all of them are broadcast up to ``BROADCAST_ROWS``; beyond, each text is
read once to see which pairs it asks for, and gets these. Running lines are counted for each owner.
Equal clean texts count once, so a corpus given twice gives the same rows.

Cases: null texts have no lines and stay null, empty texts stay empty; of rows repeated under one id one is read;
rows with a null id are ignored; extra columns are ignored; without clean texts no word counts as misread.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.storage import stash

SUPPORT = 3
COMMON_WORDS = 30_000
BROADCAST_ROWS = 300_000
#: Words of one part of the vocabulary, about.
PART_WORDS = 40_000
#: Marks that break a word at a line's end.
BREAKS = "-­‐‑‒–−¬"
#: What a scan makes of letters (right, read).
MISREADINGS = (
    ("a", "@"), ("o", "0"), ("e", "c"), ("i", "1"), ("l", "1"), ("t", "l"), ("n", "ri"), ("s", "5"), ("d", "cl"),
    ("u", "ii"), ("v", "\\/"), ("m", "rn"), ("g", "9"), ("h", "li"), ("b", "6"), ("ó", "6"), ("ã", "â"), ("s", "$"),
    ("i", "|"), ("l", "|"), ("i", "l"), ("l", "i"), ("í", "ì"), ("ç", "¢"), ("o", "ó"), ("z", "2"), ("e", "€"),
    ("b", "8"), ("q", "9"), ("w", "vv"), ("é", "ê"), ("i", "!"), ("l", "!"), ("õ", "ô"), ("á", "à"), ("c", "("),
)
_EDGE = ".,;:()\"'“”?«»[]"
_PLAIN = re.compile(r"^[^\w]*[\d.,/%ºª°]*[^\w]*$|^[RU]\$$|^\d+[.,\d]*%?$", re.IGNORECASE)
_ENDED = re.compile(r"[.;:!?][\"”')]?\s*$")
_PAGE = re.compile(r"^(?:p|pg|pag|pagina|fl|fls|folha|folhas|page)$")
_ITEM = re.compile(r"^\s*(?:[A-Za-z]{1,2}\)|[•\-–]|\d+(?:\.\d+)*[.)]?)\s+\S")


def bare(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def word_of(token: str) -> str:
    """A token as it is looked up: lower case, without the marks around it."""
    return token.strip(_EDGE).lower()


_word = functools.lru_cache(maxsize=200_000)(word_of)
_bare_word = functools.lru_cache(maxsize=200_000)(bare)


def is_wordlike(word: str) -> bool:
    return len(word) > 1 and any(c.isalpha() for c in word) and not _PLAIN.match(word) and not re.fullmatch(r"\d+[.,/\-\d]*[a-zºª]?|\d+h\d*|[a-z]?\d+[\d.,/\-]*|r\$.*|.*@.*\..*|https?.*|www.*", word)


class Trie:
    """Vocabulary as a trie whose nodes know the lengths of the words below them.

    A node is [children, whether a word ends here, shortest word below, longest word below].
    """

    def __init__(self, words: list[str]):
        self.root: list = [{}, False, 1 << 30, 0]
        for word in words:
            node, n = self.root, len(word)
            for c in word:
                node = node[0].setdefault(c, [{}, False, 1 << 30, 0])
                node[2], node[3] = min(node[2], n), max(node[3], n)
            node[1] = True

    def within(self, token: str, distance: int) -> list[str]:
        """All words at most this far from the token: the trie walked together with the token's Levenshtein
        automaton. A state is one bit mask for each number of edits; bit j says that j characters are consumed."""
        found: list[str] = []
        n = len(token)
        every, last = (1 << (n + 1)) - 1, 1 << n
        at: dict[str, int] = {}
        for j, c in enumerate(token):
            at[c] = at.get(c, 0) | 1 << (j + 1)
        start = tuple((1 << (e + 1)) - 1 & every for e in range(distance + 1))
        stack = [(self.root, "", start)]
        levels = range(1, distance + 1)
        while stack:
            node, word, state = stack.pop()
            for c, child in node[0].items():
                if child[2] > n + distance or child[3] < n - distance:
                    continue
                mask = at.get(c, 0)
                low = state[0]
                now = (low << 1) & mask
                new = [now]
                for e in levels:
                    here = state[e]
                    now = (((here << 1) & mask) | low | (low << 1) | (now << 1)) & every
                    new.append(now)
                    low = here
                if not now:
                    continue
                if child[1] and now & last:
                    found.append(word + c)
                stack.append((child, word + c, new))
        return found


_BY_READ: dict[str, list[str]] = {}
for _right, _read in MISREADINGS:
    _BY_READ.setdefault(_read, []).append(_right)


def explained(word: str, token: str, most: int = 3) -> int | None:
    """Fewest known misreadings that turn the word into the token, or None if they can't."""

    @functools.lru_cache(maxsize=None)
    def least(i: int, j: int, left: int) -> int | None:
        if i == len(word) and j == len(token):
            return 0
        best = None
        if i < len(word) and j < len(token) and word[i] == token[j]:
            best = least(i + 1, j + 1, left)
        if left and i < len(word):
            for size in (1, 2):
                if word[i] in _BY_READ.get(token[j : j + size], ()) and j + size <= len(token):
                    got = least(i + 1, j + size, left - 1)
                    if got is not None and (best is None or got + 1 < best):
                        best = got + 1
        return best

    return least(0, 0, most)


def first_letters(token: str) -> set[str]:
    """Letters that a word can begin with of which the token is a misreading."""
    return {token[:1], *_BY_READ.get(token[:1], ()), *_BY_READ.get(token[:2], ())}


def is_odd(token: str) -> bool:
    return any(not c.isalpha() and c != "-" for c in token)


def candidates_in(trie: Trie, token: str) -> list[tuple[int, int, str]]:
    """(tier, cost, word) of the words of a trie that the token may be; the lowest tier of all tries counts.

    A misreading costs at most two edits; words that one explains come before words that need more, and those
    before words of letters at one edit from a token that holds an odd character.
    """
    for distance in range(2, (3 if len(token) > 6 else 2) + 1):
        out = [(distance, cost, word) for word in trie.within(token, distance) if (cost := explained(word, token))]
        if out:
            return out
    return [(9, 3, w) for w in trie.within(token, 1) if not is_odd(w)] if is_odd(token) else []


Answer = tuple[bool, list[tuple[int, str, int]]]


class Repairer:
    """Classifies the lines of scanned texts and repairs them.

    ``answers`` says of a form that is no common word whether it is known, and what it may be a misreading of.
    """

    def __init__(self, words: dict[str, int], pairs: dict[tuple[str, str], int], answers: dict[str, Answer]):
        self.words, self.pairs, self.answers = words, pairs, answers

    def candidates(self, token: str) -> list[tuple[int, str, int]]:
        return self.answers.get(token, (False, []))[1]

    def known(self, word: str) -> bool:
        return word in self.words or self.answers.get(word, (False,))[0]

    def counted(self, word: str) -> bool:
        """Whether the clean texts hold the word; the answer to such a form names the form itself."""
        return word in self.words or any(w == word for _, w, _ in self.answers.get(word, (False, []))[1])

    def right(self, token: str, before: str, after: str) -> str | None:
        """What a misread token should be, or None if it isn't misread."""
        if self.known(token) or not is_wordlike(token) and not re.fullmatch(r"[0156@|]", token):
            return None
        if len(token) == 1:
            if token == "0" and (self.pairs.get((before, "o")) or self.pairs.get(("o", after))) and self.counted(after) and len(after) > 2:
                return "o"
            if token in "@" and self.counted(after):
                return "a"
            return None
        best = None
        for cost, word, n in self.candidates(token):
            score = (-cost, math.log1p(self.pairs.get((before, word), 0)) + math.log1p(self.pairs.get((word, after), 0)), n, word)
            if best is None or score > best:
                best = score
        return best[3] if best else None

    def furniture(self, line: str, width: int, owner: frozenset[str], running: frozenset[str]) -> bool:
        text = line.strip()
        if not text:
            return False
        said = text.split()
        if len(said) > 3 and sum(map(len, said)) > 2 * len(said):
            words = [_word(w) for w in said]
            if sum(map(self.counted, words)) > 0.7 * len(said) and not any(_bare_word(w) in owner for w in words):
                # plain wording, unless it recurs and its words do not follow one another so in clean texts
                if _bare_word(words[0]) not in self._heads(running):
                    return False
                return self._recurs(text, skeleton(text), width, running)
        parts = skeleton(text)
        digits = bool(re.search(r"\d", text))
        if not parts:
            return bool(re.fullmatch(r"[^\w.,%]*\d{1,4}(?:\s*[/|\-–—]\s*\d{1,4})?[^\w.,%]*", text))
        if _PAGE.match(parts[0]) and digits and len(parts) <= 3 and all(p in ("de", "of", "n") or _PAGE.match(p) for p in parts[1:]):
            return True
        if parts[0] == "processo" and len(parts) <= 2 and re.search(r"\d{5}\.?\d{6}/?\d{4}-?\d{2}", text) and len(text) < 40:
            return True
        company = {"s", "a", "sa", "rev", "condicoes", "gerais", "especiais", "de", "do", "da", "e", "cia"}
        if owner and all(p in owner or p in company for p in parts) and any(p in owner for p in parts) and len(text) < 80 and not text[0].islower() | (not digits and _ENDED.search(text) is not None and "s.a" not in bare(text)):
            return True
        if owner and len(parts) >= 2 and all(p in owner or p in company for p in parts) and sum(p in owner for p in parts) >= 2:
            return True
        return self._recurs(text, parts, width, running)

    def _heads(self, running: frozenset[str]) -> set[str]:
        """First words of running lines; those of the last set asked for are kept."""
        if self.__dict__.get("_of") is not running:
            self._of, self._first = running, {r.split(" ", 1)[0] for r in running}
        return self._first

    def _recurs(self, text: str, parts: list[str], width: int, running: frozenset[str]) -> bool:
        if " ".join(parts) not in running or _ENDED.search(text) and "s.a" not in bare(text) or not (len(text) < 0.85 * width or width > 110):
            return False
        pairs = list(zip(parts, parts[1:]))
        known = sum(p in self._bare_pairs for p in pairs)
        return known < 0.75 * len(pairs) or len(parts) <= 6 and bool(re.search(r"\d", text)) or not pairs

    @functools.cached_property
    def _bare_pairs(self) -> set[tuple[str, str]]:
        return {(bare(a), bare(b)) for a, b in self.pairs}

    def read(self, text: str, owner: frozenset[str], running: frozenset[str] = frozenset()) -> tuple[list[tuple[int, str]], str]:
        """Kinds of the lines, as (line number, kind), and the repaired text."""
        lines = text.split("\n")
        width = max((len(x.rstrip()) for x in lines), default=0)
        kinds: list[tuple[int, str]] = []
        wording = []
        for no, line in enumerate(lines):
            if self.furniture(line, width, owner, running):
                kinds.append((no, "furniture"))
            else:
                wording.append((no, line))
        full = [(no, got) for no, line in wording if (got := line.split())]
        tokens: list[list] = []  # token, numbers of its lines, length of its part on the first
        joined = False
        for k, (no, got) in enumerate(full):
            if joined and got:
                got = got[1:]
                joined = False
            for t, token in enumerate(got):
                last = t == len(got) - 1
                nxt = full[k + 1] if last and k + 1 < len(full) else None
                if last and nxt and len(token) > 1 and token[-1] in BREAKS and (token[-2].isalpha() or not token[-2].isspace() and token[-2] not in _EDGE) and any(c.isalpha() for c in token):
                    rest, stem = nxt[1][0], token[:-1]
                    whole, hyphened = word_of(stem + rest), word_of(stem + "-" + rest)
                    if self._is_break(whole, hyphened, token[-1]):
                        kinds.append((no, "split_word"))
                        tokens.append([stem + rest, (no, nxt[0]), len(stem)])
                    else:
                        tokens.append([stem + "-" + rest, (no, nxt[0]), len(stem) + 1])
                    joined = True
                else:
                    tokens.append([token, (no, no), len(token)])
        wrong: set[int] = set()
        words = [_word(t[0]) for t in tokens]
        for i, (token, (first, second), size) in enumerate(tokens):
            right = self.right(words[i], words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else "")
            if right is None:
                continue
            at = token.lower().find(words[i])
            prefix = next((k for k, (x, y) in enumerate(zip(words[i], right)) if x != y), min(len(words[i]), len(right)))
            wrong.add(first if first == second or at + prefix < size else second)
            fixed = right.upper() if token.isupper() and len(right) > 1 else right[0].upper() + right[1:] if token[at : at + 1].isupper() else right
            tokens[i][0] = token[:at] + fixed + token[at + len(words[i]) :]
        kinds += [(no, "misread") for no in sorted(wrong)]
        return sorted(kinds), self._reflow(lines, {no for no, k in kinds if k == "furniture"}, tokens, width)

    def _is_break(self, whole: str, hyphened: str, mark: str) -> bool:
        if self.known(hyphened):
            return self.known(whole) and mark != "-"
        if self.known(whole):
            return True
        cost = min((c for c, _, _ in self.candidates(whole)), default=9)
        return cost <= min((c for c, w, _ in self.candidates(hyphened) if "-" in w), default=9)

    def _reflow(self, lines: list[str], gone: set[int], tokens: list[list], width: int) -> str:
        by_line: dict[int, list[str]] = {}
        for token, (first, _), _size in tokens:
            by_line.setdefault(first, []).append(token)
        out: list[str] = []
        fresh = True
        before = ""
        for no, line in enumerate(lines):
            if no in gone:
                continue
            if not line.strip():
                # a blank line inside a sentence was the edge of a page
                fresh = fresh or not before or _ENDED.search(before) is not None
                continue
            said = " ".join(by_line.get(no, []))
            if not said:
                continue
            ended = _ENDED.search(before) is not None
            start = fresh or _ITEM.match(line) or (ended and len(before) < 0.75 * width) or (ended and width > 110)
            if start or not out:
                out.append(said)
            else:
                out[-1] += " " + said
            fresh, before = False, line.rstrip()
        return "\n".join(out)


def skeleton(text: str) -> list[str]:
    """A line's words without accents and digits, spaced-out words closed up, digits inside words read as letters."""
    got = bare(text)
    got = re.sub(r"\b(?:[a-z] ){2,}[a-z]\b", lambda m: m.group().replace(" ", ""), got)
    out = []
    for token in re.findall(r"[\w@$|]+", got):
        if any(c.isalpha() for c in token):
            token = token.translate(str.maketrans("0159@$|", "oisgasi"))
        token = re.sub(r"[^a-z]", "", token)
        if token and not re.fullmatch(r"v", token):
            out.append(token)
    return out


def forms_of(text: str) -> set[str]:
    """Every form of a text that may be looked up: its tokens, and both ways to join a line's end to the next."""
    out: set[str] = set()
    last = ""
    for line in text.split("\n"):
        got = line.split()
        if not got:
            continue
        out.update(map(_word, got))
        if last:
            stem = last[:-1]
            out.update((word_of(stem + got[0]), word_of(stem + "-" + got[0])))
        # a line that is furniture may stand between the parts of a word
        if len(got[-1]) > 1 and got[-1][-1] in BREAKS:
            last = got[-1]
        elif len(got) > 14 or last and len(got) > 6:
            last = ""
    return out


def _counted(clean: DataFrame, text_col: str) -> DataFrame:
    """(a, b, n): words (b empty) and neighbouring pairs of all different clean texts, n of at least 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw_pairs: Counter = Counter()
        words: Counter = Counter()
        pairs: Counter = Counter()
        norm = functools.lru_cache(maxsize=200_000)(word_of)

        def settle() -> pa.RecordBatch:
            for (a, b), n in raw_pairs.items():
                x, y = norm(a), norm(b)
                if x and any(c.isalpha() for c in x):
                    words[x] += n
                    if y and any(c.isalpha() for c in y):
                        pairs[x, y] += n
            raw_pairs.clear()
            rows = [(w, "", n) for w, n in words.items()] + [(a, b, n) for (a, b), n in pairs.items()]
            words.clear()
            pairs.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], type=pa.string()), pa.array([r[1] for r in rows], type=pa.string()), pa.array([r[2] for r in rows], type=pa.int64())], names=["a", "b", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                got = text.split()
                got.append("")
                raw_pairs.update(zip(got, got[1:]))
            if len(raw_pairs) > 400_000:
                yield settle()
        yield settle()

    each = clean.select(F.col(text_col).alias("text")).where("length(text) > 0").withColumn("h", F.xxhash64("text")).dropDuplicates(["h"]).select("text")
    return stash(each.mapInArrow(run, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")).where("n >= 2"), "tokens")


class AskedPairs(dict):
    """No pairs, but those asked for. Which pairs a text asks for doesn't depend on what it is told of them."""

    def __init__(self):
        super().__init__()
        self.asked: set[tuple[str, str]] = set()

    def get(self, pair, default=None):
        self.asked.add(pair)
        return default


def _owner_words(owner: str | None) -> frozenset[str]:
    return frozenset(p for p in skeleton(owner or "") if len(p) > 1 and p != "de")


def _said_in(running: DataFrame, pairs: DataFrame) -> DataFrame:
    """(owner_key, said): neighbours in an owner's running lines, ``a b``, that clean texts hold as neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = sorted({f"{bare(a)} {bare(b)}" for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())})
            yield pa.RecordBatch.from_arrays([pa.array(got, type=pa.string())], names=["near"])

    words = running.select("owner_key", F.explode("running").alias("line")).select("owner_key", F.split("line", " ").alias("w"))
    near = F.zip_with(F.col("w"), F.slice("w", 2, F.greatest(F.lit(1), F.size("w"))), lambda x, y: F.concat_ws(" ", x, y))
    asked = words.select("owner_key", F.explode(near).alias("near")).where("near like '% %'").distinct()
    held = pairs.select("a", "b").mapInArrow(run, "near string").distinct()
    return asked.join(held, "near").groupBy("owner_key").agg(F.collect_list("near").alias("said"))


def _owner_key(owner: str | None) -> str:
    return " ".join(skeleton(owner or ""))


def _running(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(owner_key, running): each owner's lines, as skeletons, that at least SUPPORT of its documents or SUPPORT
    owners repeat; and (word) of hyphened words that stand inside lines of at least two documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: set[tuple[str, str, str]] = set()
            for doc, owner, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                key = _owner_key(owner)
                lines = text.split("\n")
                width = max(len(x.rstrip()) for x in lines)
                for line in lines:
                    stripped = line.strip()
                    # a line of nearly full width is never taken for a running one, see Repairer._recurs
                    if stripped and (len(stripped) < 0.85 * width or width > 110) and not (_ENDED.search(stripped) and "s.a" not in bare(stripped)):
                        rows.add(("line " + key, " ".join(skeleton(stripped)), doc))
                    for token in line.split()[1:-1]:
                        if "-" in token[1:-1]:
                            word = word_of(token)
                            if re.fullmatch(r"[^\W\d_]+(?:-[^\W\d_]+)+", word):
                                rows.add(("word", word, doc))
            keys = [r for r in rows if r[1]]
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], type=pa.string()) for i in range(3)], names=["kind", "said", "doc"])

    said = scanned.select("doc", "owner", "text").where("length(text) > 0").mapInArrow(run, "kind string, said string, doc string")
    counted = stash(said.groupBy("kind", "said").agg(F.countDistinct("doc").alias("n")), "running")
    lines = counted.where("kind <> 'word'")
    widely = lines.groupBy("said").agg(F.count("*").alias("owners")).where(F.col("owners") >= SUPPORT).select("said")
    often = lines.where(F.col("n") >= SUPPORT).select("kind", "said").unionByName(lines.join(widely, "said", "left_semi").select("kind", "said"))
    by_owner = often.groupBy(F.substring("kind", 6, 1 << 20).alias("owner_key")).agg(F.collect_set("said").alias("running"))
    return by_owner, counted.where("kind = 'word' and n >= 2").select(F.col("said").alias("word"))


def answers_for(forms: DataFrame, vocabulary: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """(form, known, cands ARRAY<STRUCT<cost, word, n>>) of the forms that are known or may be misread words.

    ``vocabulary`` has (word, n). Words are split by first letter, length and, where there are many, a hash; a form
    goes to every part that can hold one of its words, and each part walks its own trie.
    """
    known = forms.join(vocabulary, F.col("form") == F.col("word"), "left").select("form", "n")
    known = stash(known, "known")
    parts = max(1, math.ceil(vocabulary.count() / (part_words * 100)))

    def routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = [*map(chr, range(97, 123)), *"áàâãçéêíóôõú"]
        for batch in batches:
            rows = []
            for form in batch.column(0).to_pylist():
                if len(form) < 2 or len(form) > 60 or not is_wordlike(form):
                    continue
                first = set(letters) if not form[0].isalpha() else first_letters(form)
                for size in range(max(1, len(form) - 3), len(form) + 2):
                    rows += [(f"{size} {c} {p}", form) for c in first for p in range(parts)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=pa.string()) for i in range(2)], names=["part", "form"])

    asked = known.where("n is null").select("form").mapInArrow(routes, "part string, form string")
    where = F.concat_ws(" ", F.char_length("word").cast("string"), F.substring("word", 1, 1), F.pmod(F.xxhash64("word"), F.lit(parts)).cast("string"))
    both = vocabulary.where("char_length(word) between 1 and 61").select(where.alias("part"), F.lit(0).alias("side"), "word", "n")
    both = both.unionByName(asked.select("part", F.lit(1).alias("side"), F.col("form").alias("word"), F.lit(0).cast("long").alias("n")))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counts, trie = None, {}, None
        for batch in batches:
            rows = []
            for at, side, word, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if at != part:
                    part, counts, trie = at, {}, None
                if side == 0:
                    counts[word] = n
                    continue
                if not counts:
                    continue
                if trie is None:
                    trie = Trie(sorted(counts))
                rows += [(word, tier, cost, right, counts[right]) for tier, cost, right in candidates_in(trie, word)]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(kinds)], names=["form", "tier", "cost", "word", "n"])

    found = both.repartition("part").sortWithinPartitions("part", "side").mapInArrow(walk, "form string, tier int, cost int, word string, n bigint")
    lists = found.groupBy("form").agg(F.min("tier").alias("tier"), F.collect_set(F.struct("tier", "cost", "word", "n")).alias("every"))
    best = F.transform(F.filter("every", lambda x: x["tier"] == F.col("tier")), lambda x: F.struct(x["cost"].alias("cost"), x["word"].alias("word"), x["n"].alias("n")))
    misread = lists.select("form", F.lit(False).alias("known"), best.alias("cands"))
    none = F.array().cast("array<struct<cost:int,word:string,n:bigint>>")
    # a word of the clean texts names itself; one that only hyphened lines hold has no count
    itself = F.when(F.col("n") > 0, F.array(F.struct(F.lit(0).alias("cost"), F.col("form").alias("word"), "n"))).otherwise(none).cast("array<struct<cost:int,word:string,n:bigint>>")
    return known.where("n is not null").select("form", F.lit(True).alias("known"), itself.alias("cands")).unionByName(misread)


_last: list = []


def _repairer(shared: tuple, tables: list) -> Repairer:
    """The repairer of these tables; a worker keeps the last."""
    if not _last or _last[0] is not tables:
        _last[:] = [tables, Repairer(*shared, {f: (k, [tuple(c) for c in own]) for f, k, own in tables})]
    return _last[1]


def repair(scanned: DataFrame, clean: DataFrame, id_col: str, doc_col: str, owner_col: str, text_col: str, broadcast_rows: int = BROADCAST_ROWS, pair_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(id, kinds ARRAY<STRUCT<line_no, kind>>, repaired): every scanned text, one row per id."""
    context = scanned.sparkSession.sparkContext
    counts = _counted(clean, text_col)
    top = lambda df, n: df.orderBy(F.desc("n"), "a", "b").limit(n).collect()
    words = {a: n for a, b, n in top(counts.where((F.col("b") == "") & (F.col("n") >= SUPPORT)), COMMON_WORDS)}
    together = counts.where("b <> ''")
    all_pairs = together.count() <= pair_rows
    pairs = {(a, b): n for a, b, n in together.collect()} if all_pairs else {}
    own = scanned.select(F.col(id_col).cast("string").alias("id"), F.col(doc_col).cast("string").alias("doc"), F.col(owner_col).cast("string").alias("owner"), F.col(text_col).alias("text")).where("id is not null").dropDuplicates(["id"])
    running, compounds = _running(own)
    vocabulary = counts.where((F.col("b") == "") & (F.col("n") >= SUPPORT)).select(F.col("a").alias("word"), "n")
    vocabulary = stash(vocabulary.unionByName(compounds.join(vocabulary, "word", "left_anti").select("word", F.lit(0).cast("long").alias("n"))), "vocabulary")
    common, evidence = context.broadcast(words), context.broadcast(pairs)

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = common.value
        seen: set[str] = set()  # forms this task has asked for
        for batch in batches:
            rows = {f for t in batch.column(0).to_pylist() for f in forms_of(t) if f and f not in words and f not in seen and any(map(str.isalpha, f))}
            if len(seen) < 300_000:
                seen |= rows
            yield pa.RecordBatch.from_arrays([pa.array(sorted(rows), type=pa.string())], names=["form"])

    texts = own.where("length(text) > 0")
    answers = stash(answers_for(texts.select("text").mapInArrow(forms, "form string").distinct(), vocabulary), "answers")
    few = all_pairs and answers.count() <= broadcast_rows
    given = context.broadcast([tuple(r) for r in answers.collect()]) if few else None

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("owner_key", pa.array([_owner_key(o) for o in batch.column("owner").to_pylist()], type=pa.string()))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = common.value
        for batch in batches:
            got = [(i, f) for i, t in enumerate(batch.column("text").to_pylist()) for f in sorted(forms_of(t)) if f not in words]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array([g[0] for g in got], type=pa.int64())), pa.array([g[1] for g in got], type=pa.string())], names=["id", "form"])

    def pairs_asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                asks = Repairer(common.value, AskedPairs(), {a["form"]: (a["known"], [(c["cost"], c["word"], c["n"]) for c in a["cands"]]) for a in x["answers"] or ()})
                asks.__dict__["_bare_pairs"] = {tuple(p.split(" ")) for p in x["said"] or ()}
                asks.read(x["text"], _owner_words(x["owner"]), frozenset(x["running"] or ()))
                rows += [(x["id"], a, b) for a, b in sorted(asks.pairs.asked)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=pa.string()) for i in range(3)], names=["id", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("line_no", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            kinds, texts = [], []
            mine = batch.column("answers").to_pylist() if not few else None
            said, met = (batch.column(c).to_pylist() if not all_pairs else None for c in ("said", "met"))
            for i, (text, owner, lines) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "owner", "running")))):
                if not text:
                    kinds.append([])
                    texts.append(text)
                    continue
                if few:
                    repairer = _repairer((common.value, evidence.value), given.value)
                else:
                    own = {(p["a"], p["b"]): p["n"] for p in met[i] or ()} if met else evidence.value
                    repairer = Repairer(common.value, own, {a["form"]: (a["known"], [(c["cost"], c["word"], c["n"]) for c in a["cands"]]) for a in mine[i] or ()})
                    repairer.__dict__["_bare_pairs"] = _bare_pairs_of(evidence.value) if all_pairs else {tuple(x.split(" ")) for x in said[i] or ()}
                marks, mended = repairer.read(text, _owner_words(owner), frozenset(lines or ()))
                kinds.append([{"line_no": n, "kind": k} for n, k in marks])
                texts.append(mended)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(kinds, type=kind), pa.array(texts, type=pa.string())], names=["id", "kinds", "repaired"])

    keyed = own.mapInArrow(key, "id string, doc string, owner string, text string, owner_key string")
    if not all_pairs:
        running = running.join(_said_in(running, together), "owner_key", "left")
    running = stash(running, "running")
    ready = keyed.join(F.broadcast(running) if running.count() <= 20_000 else running, "owner_key", "left")
    if few:
        ready = ready.select("id", "owner", "text", "running")
    else:
        per = texts.select("id", "text").mapInArrow(asked, "id string, form string").join(answers, "form")
        per = per.groupBy("id").agg(F.collect_list(F.struct("form", "known", "cands")).alias("answers"))
        ready = ready.join(per, "id", "left").drop("doc", "owner_key")
    if not all_pairs:
        ready = stash(ready, "ready")
        met = ready.where("length(text) > 0").mapInArrow(pairs_asked, "id string, a string, b string").join(together, ["a", "b"])
        ready = ready.join(met.groupBy("id").agg(F.collect_list(F.struct("a", "b", "n")).alias("met")), "id", "left")
    return ready.mapInArrow(run, "id string, kinds array<struct<line_no:bigint,kind:string>>, repaired string").withColumnRenamed("id", id_col)


_bare: list = []


def _bare_pairs_of(pairs: dict) -> set[tuple[str, str]]:
    if not _bare or _bare[0] is not pairs:
        _bare[:] = [pairs, Repairer({}, pairs, {})._bare_pairs]
    return _bare[1]
