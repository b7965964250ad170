"""Column functions over text. Every function takes and returns Spark columns; none runs Python per row."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Drop white space (any Unicode kind) at both ends."""
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """White-space runs become one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


@lru_cache(maxsize=None)
def _ascii_table() -> tuple[str, str, dict[str, str]]:
    """Rule: what is left of each character's NFKD form in ASCII. One-letter results go to ``translate``."""
    src, dst, longer = ["đ", "Đ"], ["d", "D"], {}
    for cp in range(0x80, 0x20000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        left = "".join(x for x in unicodedata.normalize("NFKD", ch) if ord(x) < 128)
        if len(left) == 1:
            src.append(ch)
            dst.append(left)
        elif left:
            longer[ch] = left
    return "".join(src), "".join(dst), longer


@lru_cache(maxsize=None)
def _fold_table() -> tuple[str, str]:
    """Rule: letters whose canonical decomposition is one base letter plus combining marks."""
    src, dst = [], []
    for cp in range(0x80, 0x20000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        parts = unicodedata.normalize("NFD", ch)
        base = [x for x in parts if not unicodedata.combining(x)]
        if len(parts) > 1 and len(base) == 1 and ch.lower() == ch:
            src.append(ch)
            dst.append(base[0])
    return "".join(src), "".join(dst)


def to_ascii(c: Column) -> Column:
    """Compatibility-decompose and keep ASCII: accents go, ligatures open, other scripts are dropped.

    Text that is ASCII already is left as it is. Characters that open to several letters are looked for by ``translate``, a
    lookup per character; a class of hundreds of characters in a pattern would be tried one by one.
    """
    src, dst, longer = _ascii_table()
    expand = F.create_map(*[F.lit(x) for kv in longer.items() for x in kv])
    letters = F.transform(F.split(c, ""), lambda ch: F.coalesce(F.when(ch > "\x7f", F.try_element_at(expand, ch)), ch))
    opens = F.translate(c, "".join(longer), "") != c
    opened = F.when(opens, F.array_join(letters, "")).otherwise(c)
    plain = F.regexp_replace(F.translate(opened, src, dst), r"[^\x00-\x7F]", "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), plain).otherwise(c)


def fold(c: Column) -> Column:
    """Lower case without diacritics, for search: 'Ghế' and 'ghe' are the same word."""
    src, dst = _fold_table()
    return F.regexp_replace(F.translate(F.lower(c), src, dst), r"\p{Mn}", "")


def slugify(c: Column, sep: str = "-", max_len: int = 48) -> Column:
    """ASCII words joined by ``sep``, cut at ``max_len`` without a dangling separator; never empty."""
    words = F.regexp_replace(F.lower(to_ascii(c)), "[^a-z0-9]+", sep)
    cut = F.substring(F.btrim(words, F.lit(sep)), 1, max_len)
    cut = F.rtrim(cut, F.lit(sep))
    return F.regexp_replace(cut, "^$", "x")  # the words are read once; with ``when`` they would be read for each use


def sql_ident(c: Column) -> Column:
    """Snake-case identifier that never starts with a digit."""
    return F.regexp_replace(slugify(c, "_", 60), "^(?=[0-9])", "c_")


def decode_text(c: Column) -> Column:
    """Bytes to text: UTF-8 (byte-order mark dropped), else Windows-1252, else Latin-1."""
    high = {b: bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
    defined = {b: ch for b, ch in high.items() if ch}
    undefined = "[" + "".join(chr(b) for b, ch in high.items() if not ch) + "]"
    latin = F.decode(c, "ISO-8859-1")
    windows = F.translate(latin, "".join(map(chr, defined)), "".join(defined.values()))
    utf8 = F.regexp_replace(F.try_validate_utf8(c.cast("string")), "^\ufeff", "")
    return F.when(utf8.isNotNull(), utf8).when(latin.rlike(undefined), latin).otherwise(windows)


def truncate_text(c: Column, n: int) -> Column:
    """struct(text, cut): at most ``n`` characters, at the last line break if that keeps 60 %."""
    head = F.substring(c, 1, n)
    at_line = F.regexp_extract(head, r"(?s)^(.*)\n", 1)
    has_line = head.contains("\n")
    kept = F.when(has_line & (F.length(at_line) >= n * 0.6), at_line).otherwise(head)
    fits = F.length(c) <= n
    return F.struct(F.when(fits, c).otherwise(kept).alias("text"), (~fits).alias("cut"))


def lead_text(c: Column, n: int = 220) -> Column:
    """First ``n`` characters of the collapsed text, with an ellipsis when something is left out."""
    flat = collapse(c)
    return F.concat(F.substring(flat, 1, n), F.when(F.length(flat) > n, F.lit(" …")).otherwise(F.lit("")))


def norm_quote(c: Column) -> Column:
    """Quotes, dashes and spaces in one form and lower case, so that only the words are compared."""
    plain = F.translate(c, "’‘“”–— ", "''\"\"-- ")
    return F.lower(collapse(plain))


def content_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def glob_to_regex(glob: str) -> str:
    """Shell pattern as an anchored regular expression; ``*`` also crosses ``/``."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        end = glob.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif end > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = end
        else:
            out.append(ch if ch.isalnum() or ch in "_/ -" else "\\" + ch)
        i += 1
    return "(?s)^" + "".join(out) + "$"
