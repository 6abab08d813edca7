"""Text as Columns: cleaning, names, contexts, formats. All are built-in expressions, so they stay in the JVM."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import catalogue

# White space and digits as Unicode has them.
SPACES = r"(?U)\s+"
_ACCENTED = [c for c in map(chr, range(0xC0, 0x250)) if len(unicodedata.normalize("NFD", c)) > 1 and ord(unicodedata.normalize("NFD", c)[0]) < 128]
_PLAIN = [unicodedata.normalize("NFD", c)[0] for c in _ACCENTED]


def quoted(term: str) -> str:
    """A regex of a literal, alike in Java and RE2."""
    return re.sub(r"([^\w\s])", r"\\\1", term)


def any_of(words, boundaries: bool = True) -> str:
    body = "(?:" + "|".join(quoted(w) for w in words) + ")"
    return rf"\b{body}\b" if boundaries else body


def unaccented(c: Column) -> Column:
    """Latin letters without their marks, composed or not."""
    return F.regexp_replace(F.translate(c, "".join(_ACCENTED), "".join(_PLAIN)), r"\p{Mn}+", "")


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACES, " "))


def preprocess(c: Column) -> Column:
    """Spaces squeezed, ligatures and typographic quotes spelt plainly, control characters gone."""
    out = F.regexp_replace(c, SPACES, " ")
    for old, new in (("œ", "oe"), ("Œ", "OE"), ("æ", "ae"), ("Æ", "AE")):
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.translate(out, "«»“”‘’", "\"\"\"\"''")
    return F.trim(F.regexp_replace(out, r"[\x00-\x08\x0B-\x1F]", ""))


def clean_value(c: Column) -> Column:
    """Trimmed, without closing punctuation and control characters, spaces squeezed."""
    out = F.regexp_replace(F.trim(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"[.,;:!?]+$", "")
    return F.regexp_replace(F.regexp_replace(out, r"[\x00-\x1F\x7F-\x9F]", ""), SPACES, " ")


def without_title(c: Column, titles, dot: bool = True) -> Column:
    """The name after a leading civil title, which is written with its accents or without."""
    bare = [t.strip().rstrip(".") for t in titles]
    forms = sorted({f for t in bare if t for f in (t, "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)))})
    return F.regexp_replace(c, rf"(?iU)^{any_of(forms, False)}{r'\.?' if dot else ''}\s+", "") if forms else F.regexp_replace(c, r"(?U)^\s+", "")


def person_key(c: Column) -> Column:
    """What two spellings of a person's name share: no title, accents, case, or signs but the hyphen."""
    # Fixed value: titles as they stand before a name.
    out = F.regexp_replace(F.trim(c), r"(?iU)^(?:m\.?|mme|mlle|mle|mr|dr|me|ma[iî]tre)\s+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(unaccented(out)), r"[^a-z\s-]", ""), r"\s+", " "))


def person_signature(c: Column) -> Column:
    """What makes two person spans the same: accents count, title and case don't."""
    return F.trim(F.lower(F.regexp_replace(c, rf"(?iU)^{catalogue.TITLES}\s+", "")))


def last_name(c: Column, titles=catalogue.NAME_TITLES) -> Column:
    """The last word and the particles before it; a last word that is a particle goes on."""
    words = F.filter(F.split(F.lower(unaccented(without_title(c, titles))), r"\s+"), lambda w: w != "")
    particles = F.array(*map(F.lit, catalogue.PARTICLES))
    # From the end: taken words, and whether a proper word was among them, after which only particles may follow.
    start = F.struct(F.array().cast("array<string>").alias("name"), F.lit(False).alias("proper"), F.lit(True).alias("open"))

    def step(s: Column, w: Column) -> Column:
        particle = F.array_contains(particles, w)
        take = s["open"] & (particle | ~s["proper"])
        return F.struct(F.when(take, F.array_prepend(s["name"], w)).otherwise(s["name"]).alias("name"), (s["proper"] | (take & ~particle)).alias("proper"), take.alias("open"))

    return F.coalesce(F.array_join(F.aggregate(F.reverse(words), start, step, lambda s: s["name"]), " "), F.lit(""))


def name_parts(c: Column, titles=catalogue.PERSON_TITLES) -> Column:
    """Struct of canonical, first_names, last_name, particles."""
    words = F.regexp_extract_all(F.lower(unaccented(F.trim(without_title(c, titles)))), F.lit(r"(?U)[\w'-]+"), F.lit(0))
    whole = F.array_join(words, " ")
    tail = F.split(last_name(whole, ()), " ")
    n = F.when(F.size(words) > 0, F.size(tail)).otherwise(0)
    first = F.slice(words, 1, F.greatest(F.size(words) - n, F.lit(0)))
    particles = F.array(*map(F.lit, catalogue.PARTICLES))
    return F.struct(
        whole.alias("canonical"),
        first.alias("first_names"),
        F.coalesce(F.get(words, F.size(words) - 1), F.lit("")).alias("last_name"),
        F.filter(F.slice(tail, 1, F.greatest(F.size(tail) - 1, F.lit(0))), lambda w: F.array_contains(particles, w)).alias("particles"),
    )


def metaphone_fr(c: Column) -> Column:
    """A crude French sound code."""
    out = F.regexp_replace(F.lower(unaccented(c)), "[^a-z]", "")
    # Letters that sound as one.
    for old, new in (("ph", "f"), ("th", "t"), ("ch", "x"), ("gn", "n"), ("qu", "k"), ("ck", "k"), ("cq", "k")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.upper(F.concat(F.substring(out, 1, 1), F.regexp_replace(F.substring(out, F.lit(2), F.length(out)), "[aeiouy]", "")))


def context(text: Column, start: Column, end: Column, width: int = 80) -> Column:
    """The span between ** and `width` characters on either side."""
    first = F.greatest(start - width, F.lit(0))
    return F.trim(F.concat(F.substring(text, first + 1, start - first), F.lit("**"), F.substring(text, start + 1, end - start), F.lit("**"), F.substring(text, end + 1, F.lit(width))))


def preceding_word(text: Column, start: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(F.substring(text, F.lit(1), start), r"(?U)\s+$", ""), r"(?U)(\w+)$", 1)


def file_size(n: Column) -> Column:
    """Bytes in the largest unit that gives at least 1, with one digit after the point."""
    n = n.cast("double")
    out = F.when(n == 0, F.lit("0 B"))
    for k, unit in enumerate(("B", "KB", "MB", "GB")):
        out = out.when((n < 1024.0 ** (k + 1)) | F.lit(k == 3), F.concat(F.format_string("%.1f", F.bround(n / 1024.0**k, 1)), F.lit(f" {unit}")))
    return out


def safe_filename(c: Column, most: int = 255) -> Column:
    """Forbidden characters as underscores, cut to a length that keeps the extension."""
    out = F.regexp_replace(c, r'[<>:"/\\|?*]', "_")
    ext = F.regexp_extract(out, r"[^.](\.[^.]*)$", 1)
    return F.when(F.length(out) > most, F.concat(F.substring(out, F.lit(1), F.lit(most) - F.length(ext)), ext)).otherwise(out)


def slug(c: Column) -> Column:
    """Runs of other characters than letters and digits as one underscore, none at the ends, in upper case."""
    return F.upper(F.regexp_replace(F.regexp_replace(c, "[^0-9A-Za-z]+", "_"), "^_+|_+$", ""))


def bracketed(c: Column) -> Column:
    """The parts of `[a], [b]`."""
    return F.regexp_extract_all(c, F.lit(r"\[(.*?)\]"), F.lit(1))


def in_brackets(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit("["), p, F.lit("]"))), ", ")


def short_form(c: Column) -> Column:
    """A shorter form to offer for a value: its leading verb alone, or the value without long titles; null if there is none."""
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    first = F.get(words, F.lit(0))
    without = F.array_join(F.filter(words, lambda w: ~F.lower(w).isin(*catalogue.SHORT_TITLES)), " ")
    titled = F.lower(c).rlike("|".join(catalogue.SHORT_TITLES))
    return F.when((F.size(words) > 2) & F.lower(first).isin(*catalogue.LEADING_VERBS), first).when(titled & (without != c), without)
