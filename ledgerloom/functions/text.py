"""Text functions of the statement parsers: accent folding, fuzzy containment, labels. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_es(s: Column) -> Column:
    """Lower case, without the Spanish accents."""
    return F.translate(F.lower(s), "áéíóúñ", "aeioun")


def upper_ascii(s: Column) -> Column:
    """Only a-z change."""
    return F.translate(s, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def clean_ocr(s: Column) -> Column:
    return F.regexp_replace(s, r"^[ \t]+|[ \t\n\r]+$", "")


def split_tokens(s: Column) -> Column:
    return F.filter(F.split(s, r"\s+"), lambda t: t != "")


def normalize_label(s: Column) -> Column:
    """Without blanks, in upper case: labels that OCR has spaced out compare equal."""
    return F.upper(F.regexp_replace(s, "[ \t]", ""))


def fuzzy_match(text: Column, keywords: str) -> Column:
    """Every keyword occurs in the text, accents and case aside."""
    t, out = norm_es(text), F.lit(True)
    for k in keywords.split():
        out = out & F.contains(t, norm_es(F.lit(k)))
    return out


def pieces(needle: str, n: int) -> list[str]:
    """The needle cut into n parts of about equal length."""
    cut = [len(needle) * i // n for i in range(n + 1)]
    return [needle[i:j] for i, j in zip(cut, cut[1:])]


def may_contain(text: Column, needle: str, distance: int) -> Column:
    """False where no substring of the text can be within the edit distance of the needle: of distance + 1 parts of the needle, so few edits leave one untouched."""
    out = F.lit(len(needle) <= distance)
    for part in pieces(needle, distance + 1):
        out = out | F.contains(text, F.lit(part))
    return out


def fuzzy_contains(text: Column, needle: str, distance: int) -> Column:
    """Some substring of the text is within the edit distance of the needle; the exact substring is looked for first.

    Texts that cannot have one are told apart without any distance being computed.
    """
    n = len(needle)
    size = F.length(text)
    near = F.exists(
        F.sequence(F.lit(1), F.greatest(F.lit(1), size)),
        # the longest stretch from here must have a part of the needle
        lambda i: may_contain(F.substr(text, i, F.lit(n + distance)), needle, distance)
        & F.exists(
            F.sequence(F.lit(max(1, n - distance)), F.lit(n + distance)),
            lambda k: (i + k - 1 <= size) & (F.levenshtein(F.substr(text, i, k), F.lit(needle)) <= distance),
        ),
    )
    short = (size < n - distance) & (F.levenshtein(text, F.lit(needle)) <= distance)
    exact = F.contains(text, F.lit(needle))
    may = may_contain(text, needle, distance)
    return F.coalesce(exact if not distance else F.when(exact, True).when(~may, False).when(size < n - distance, short).otherwise(near), F.lit(False))


def tolerance(needle: str) -> int:
    return 2 if len(needle) >= 5 else 1 if len(needle) >= 3 else 0


def contains_all(text: Column, *needles: str) -> Column:
    """Every needle, with a tolerance that grows with its length. Distances are only computed where all needles may be there, and to the longest first."""
    needles, out = sorted(needles, key=len, reverse=True), F.lit(True)
    for test in (may_contain, fuzzy_contains):
        for n in needles:
            out = out & test(text, n, tolerance(n))
    return out


def escape_csv(s: Column) -> Column:
    """Quoted only if it holds a comma, a quote or a line break; quotes doubled."""
    return F.when(s.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def file_kind(path: Column) -> Column:
    """'image', 'pdf' or null by the extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1))
    return F.when(ext.isin("png", "jpg", "jpeg", "bmp", "tif", "tiff"), "image").when(ext == "pdf", "pdf")
