"""Text expressions, all built from Spark's own functions so that they stay inside generated code."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are runs of letters, digits and underscores; combining marks part them.
TOKEN = r"[\p{L}\p{N}_]+"


def _folding() -> tuple[str, str]:
    """Precomposed Latin letters and what they are without accents, by rule."""
    pairs = []
    for c in range(0xC0, 0x250):
        bare = unicodedata.normalize("NFD", chr(c))
        if len(bare) > 1 and bare[0].isascii():
            pairs.append((chr(c), bare[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _folding()


def fold(c: Column | str) -> Column:
    """Lower case without accents."""
    return F.lower(F.translate(c, ACCENTED, PLAIN))


def tokens(c: Column | str) -> Column:
    """Lower-case words with their accents, in order; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(f"({TOKEN})"), 1), F.array().cast("array<string>"))


def squeeze(c: Column | str) -> Column:
    """Outer white space gone, inner runs a single blank."""
    return F.regexp_replace(F.regexp_replace(c, r"\s+", " "), "^ | $", "")


def normalize_layout(c: Column | str) -> Column:
    """Soft hyphens gone, no-break spaces as blanks, typographic quotes as plain ones."""
    x = F.translate(c, " ‘’‚‛′“”„‟″«»­", " '''''\"\"\"\"\"\"\"")
    return x


def mask_digits(c: Column | str) -> Column:
    """Each run of digits as one ``#``."""
    return F.regexp_replace(c, "[0-9]+", "#")


def slug(c: Column | str) -> Column:
    """Folded, other characters as single hyphens, ``part`` if nothing is left."""
    x = F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(x == "", "part").otherwise(x)


def dot_leader(c: Column | str) -> Column:
    """A table-of-contents line: four dots or more, then a page number at the end."""
    return F.coalesce(F.regexp_like(c, F.lit(r"\.{4,}\s*[0-9]{1,4}\s*$")), F.lit(False))


def list_item(c: Column | str) -> Column:
    """A lettered or bulleted item line."""
    return F.coalesce(F.regexp_like(c, F.lit(r"^([A-Za-z]{1,2}\)|[•–-])\s+\S")), F.lit(False))


def rejoins(line: Column | str, following: Column | str) -> Column:
    """A word broken over two lines: letter and hyphen, then a lower-case letter."""
    return F.regexp_like(line, F.lit(r"\p{L}-$")) & F.regexp_like(following, F.lit(r"^\p{Ll}"))


def title_key(c: Column | str) -> Column:
    """A title without its numbering, folded; null if nothing is left."""
    return F.nullif(squeeze(fold(F.regexp_replace(c, r"^\s*[0-9]+(\.[0-9]+)*[.)]?\s*", ""))), F.lit(""))


def cross_references(c: Column | str) -> Column:
    """Distinct clause numbers referred to, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?i)cl[áa]usulas?\s+([0-9]+(?:\.[0-9]+)*)"), 1))


#: Label and shape of each detector, in the order of their labels; shapes stand between word ends.
SHAPES = (
    ("plate_old_format", r"[A-Za-z]{3}-?[0-9]{4}"),
    ("plate_mercosul_format", r"[A-Za-z]{3}[0-9][A-Za-z][0-9]{2}"),
    ("cpf_like", r"[0-9]{3}\.?[0-9]{3}\.?[0-9]{3}-?[0-9]{2}"),
    ("rg_like", r"[0-9]{1,2}\.?[0-9]{3}\.?[0-9]{3}-?[0-9Xx]"),
)
#: Fixed value: two capitalised words.
TWO_NAMES = r"[A-ZÀ-Ý][a-zà-ÿ]+\s+[A-ZÀ-Ý][a-zà-ÿ]+"


def personal_flags(c: Column | str) -> Column:
    """Labels of the five shape detectors that hit, in fixed order; two capitalised words count unless a sentence
    begins with them."""
    word = r"[\p{L}\p{N}_]"
    detectors = [(n, rf"(?<!{word}){p}(?!{word})") for n, p in SHAPES]
    detectors.append(("possible_proper_name", rf"(?<![.!?]\s)(?<!{word}){TWO_NAMES}(?!{word})"))
    return F.array_compact(F.array(*[F.when(F.regexp_like(c, F.lit(p)), F.lit(n)) for n, p in detectors]))


def fingerprint(*parts: Column | str) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by a bar."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def next_label(label: Column | str) -> Column:
    """A dotted number with its last part counted up by one; null for anything else."""
    c = F.col(label) if isinstance(label, str) else label
    last = F.regexp_extract(c, r"^(?:[0-9]+\.)*([0-9]{1,18})$", 1).try_cast("bigint") + 1
    return F.concat(F.regexp_extract(c, r"^(.*\.)?[0-9]+$", 1), last.cast("string"))


def terms_held(folded: Column, terms: tuple[str, ...]) -> Column:
    """Those of the terms that a folded text holds, in the order given."""
    return F.array_compact(F.array(*[F.when(F.contains(folded, F.lit(t)), F.lit(t)) for t in terms]))


def numbered(steps: Column | str) -> Column:
    """The elements of an array as lines ``1. first``, ``2. second``."""
    return F.array_join(F.transform(steps, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
