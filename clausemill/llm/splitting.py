"""Problem 4: cutting oversized texts at natural boundaries.

Method: structure-tree packing. A text is parsed into a tree: its list items by their marks, a mark of another form
(letters, bullets) nesting under the item before it; inside an item, headings by their depth (marked, numbered 1,
1.1, 1.1.1, or in capitals), then blocks between blank lines, lines, sentences, words, and single characters where
nothing else helps. From the leaves upward, neighbouring sibling subtrees are merged as long as they fit, so a
subtree that fits is never parted; only a node over the limit is opened. A piece that starts where no item starts
begins with up to ``overlap`` characters of the piece before, taken from a line, sentence or word start where there
is one.

Cases: texts within the limit, empty and null texts give no piece; of repeated ids one row is cut; extra columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEM = re.compile(r"^(?:[A-Za-z]{1,2}\)|[•\-–])[^\S\n]+\S", re.MULTILINE)
#: Forms of item marks; items of one form are siblings.
_FORMS = (re.compile(r"[A-Za-z]{1,2}\)"), re.compile(r"•"), re.compile(r"[\-–]"))
#: Headings from coarse to fine; a node is opened before each line that is one.
_HEADINGS = tuple(re.compile(p) for p in (r"\n(?=#[^\S\n])", r"\n(?=##[^\S\n])", r"\n(?=#{3,6}[^\S\n])", r"\n(?=[A-ZÀ-Ý][A-ZÀ-Ý\d ,.\-–]{3,80}\n)", r"\n(?=\d+[.)]?[^\S\n]+[^\W\d])", r"\n(?=\d+\.\d+[.)]?[^\S\n]+\S)", r"\n(?=\d+\.\d+\.\d+[.\d]*\)?[^\S\n]+\S)"))
#: Where a node may be opened below its headings: after a blank line, a line, a sentence, a word.
_LEVELS = (*_HEADINGS, re.compile(r"\n[^\S\n]*\n+"), re.compile(r"\n"), re.compile(r"(?<=[.!?;:])[^\S\n]+"), re.compile(r"\s+"))


def _open(text: str, start: int, end: int, room: int, level: int) -> list[tuple[int, int]]:
    """Stretches of at most ``room`` that cover [start, end) but for white space at cuts, siblings merged."""
    if end - start <= room:
        return [(start, end)]
    if level == len(_LEVELS):
        return [(s, min(end, s + room)) for s in range(start, end, room)]
    parts, at = [], start
    for gap in _LEVELS[level].finditer(text, start, end):
        if gap.start() > at and gap.end() < end:
            parts.append((at, gap.start()))
            at = gap.end()
    parts.append((at, end))
    if len(parts) == 1:
        return _open(text, start, end, room, level + 1)
    out: list[tuple[int, int]] = []
    whole = False  # the last stretch consists of whole siblings
    for s, e in parts:
        if whole and e - out[-1][0] <= room:
            out[-1] = (out[-1][0], e)
        elif e - s <= room:
            out.append((s, e))
            whole = True
        else:
            out.extend(_open(text, s, e, room, level + 1))
            whole = False
    return out


def _overlap_start(text: str, floor: int, end: int, overlap: int) -> int:
    """Where the tail of at most ``overlap`` characters of [floor, end) begins."""
    low = max(floor, end - overlap)
    if low == floor:
        return low
    for level in _LEVELS[len(_HEADINGS) + 1 :]:
        for gap in level.finditer(text, low - 1, end):
            if low <= gap.end() < end:
                return gap.end()
    return low


class Node:
    """An item with the items nested under it; ``start`` to ``own_end`` is its own text."""

    __slots__ = ("start", "own_end", "depth", "children")

    def __init__(self, start: int, own_end: int, depth: int):
        self.start, self.own_end, self.depth, self.children = start, own_end, depth, []

    @property
    def end(self) -> int:
        node = self
        while node.children:
            node = node.children[-1]
        return node.own_end


def item_tree(text: str) -> Node:
    """The root, whose own text is what stands before the first item."""
    marks = [m.start() for m in ITEM.finditer(text)]
    edges = [*marks, len(text)]
    root = Node(0, edges[0] - 1 if marks and edges[0] > 0 else edges[0], 0)
    path, depth_of = [root], {}
    for start, stop in zip(edges, edges[1:]):
        form = next(i for i, f in enumerate(_FORMS) if f.match(text, start))
        depth = depth_of.setdefault(form, path[-1].depth + 1)
        while path[-1].depth >= depth:
            path.pop()
        node = Node(start, stop - 1 if stop < len(text) else stop, depth)
        path[-1].children.append(node)
        path.append(node)
    return root


def _packed(text: str, root: Node, limit: int, room: int) -> list[tuple[int, int, bool]]:
    """Stretches (start, end, whether it is made of whole items) of at most ``limit``, in order of the text.

    Nodes are packed from the leaves upward without recursion, as items may nest as deep as the text is long.
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(node.children)
    done: dict[int, list[tuple[int, int, bool]]] = {}
    for node in reversed(order):
        if node.end - node.start <= limit and node is not root:
            done[id(node)] = [(node.start, node.end, True)]
            continue
        own = [(node.start, node.own_end, True)] if node.own_end - node.start <= limit else [(a, b, False) for a, b in _open(text, node.start, node.own_end, room, 0)]
        out = own if node.own_end > node.start or not node.children else []
        for child in node.children:
            for start, end, whole in done.pop(id(child)):
                if whole and out and out[-1][2] and end - out[-1][0] <= limit:
                    out[-1] = (out[-1][0], end, True)
                else:
                    out.append((start, end, whole))
        done[id(node)] = out
    return done[id(root)]


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """Pieces as (start, own_start, end, rule): text[start:own_start] repeats the piece before, rule is
    ``item`` for whole items and ``window`` otherwise."""
    root = item_tree(text)
    if not root.children:
        stretches = [(a, b, False) for a, b in _open(text, 0, len(text), limit - overlap, 0)]
    else:
        stretches = _packed(text, root, limit, limit - overlap)
    out: list[tuple[int, int, int, str]] = []
    for k, (a, b, whole) in enumerate(stretches):
        if whole or k == 0 or stretches[k - 1][2] or ITEM.match(text, a):
            out.append((a, a, b, "item" if whole else "window"))
            continue
        floor, end = out[-1][1], out[-1][2]
        start = _overlap_start(text, floor, end, overlap)
        if b - start > limit:  # white space between the pieces took the room
            start = max(start, b - limit) if a - end < limit else a
        out.append((start, a, b, "window"))
    return out


def pieces(clauses: DataFrame, id_col: str, text_col: str, keep: list[str], limit: int = 3000, overlap: int = 300) -> DataFrame:
    """(id, kept columns, piece_no, start_pos, own_start, end_pos, rule, text) of the texts over the limit."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than the limit")
    picked = clauses.select(F.col(id_col).alias("id"), *[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text")).where((F.char_length("text") > limit) & F.col("id").isNotNull()).dropDuplicates(["id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, got = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for no, (start, own, end, rule) in enumerate(cut(text, limit, overlap)):
                    rows.append(i)
                    got.append((no, start, own, end, rule, text[start:end]))
            take = pa.array(rows, type=pa.int64())
            columns = [batch.column("id").take(take), *[batch.column(f"k{i}").take(take) for i in range(len(keep))]]
            for n, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())):
                columns.append(pa.array([g[n] for g in got], type=kind))
            yield pa.RecordBatch.from_arrays(columns, names=["id", *[f"k{i}" for i in range(len(keep))], "piece_no", "start_pos", "own_start", "end_pos", "rule", "piece"])

    kept = "".join(f"k{i} string, " for i in range(len(keep)))
    kind = picked.schema["id"].dataType.simpleString()
    out = picked.mapInArrow(run, f"id {kind}, {kept}piece_no int, start_pos bigint, own_start bigint, end_pos bigint, rule string, piece string")
    return out.withColumnsRenamed({"id": id_col} | {f"k{i}": c for i, c in enumerate(keep)})
