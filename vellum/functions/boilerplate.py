"""Chunks without content: preambles, author blocks, venue headers, checklists and reference lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stop_word_ratio

#: fixed values: elements that are dense in symbols by nature
PROTECTED = ("equation", "algorithm", "code", "table", "figure")
#: fixed values: titles of sections without content, and what is cut from titles first
JUNK_TITLE = r"(?i)^(?:references?|reference list|bibliography|acknowledge?ments?|(?:\w+ ){0,2}checklist)$"
TITLE_NOISE = r"\\[A-Za-z]+\*?|[{}$*]|^\s*(?:[A-Z]|\d+(?:\.\d+)*)[.)]?\s+"
#: fixed values: labels of a checklist; the third is required
CHECKLIST = ("Question:", "Answer:", "Justification:", "Guidelines:")
#: fixed values: marks of reference lists, and the label of an author-year entry
BIBLIOGRAPHY = (r"\\bibitem", r"arXiv preprint", r"\bIn Proc(?:eedings|\.)", r"\bpp\.\s*\d+", r"Advances in Neural Information Processing Systems", r"\bJournal of\b", r"(?m)^\s*\[\d+\]\s")
ENTRY_LABEL = r"\[[^\]\n]{0,80}\(\d{4}[a-z]?\)[^\]\n]*\]"
#: fixed values: marks of a venue header, the first sure by itself
VENUE_SURE = r"(?i)printacmref|printfolios|@shellescape|acmcopyright|draftminted|ACM[- ]Reference[- ]Format|\bacmart\b"
VENUE = (r"(?i)\bISBN\b|\b97[89]-\d", r"(?i)10\.1145/", r"(?i)\bCCS '\d\d\b", r"(?i)Proceedings of", r"(?i)Permission to make digital")
#: fixed values: marks of a preamble
MACRO = r"\\(?:newcommand|renewcommand|providecommand|def|newtheorem|usepackage|documentclass|setlength|DeclareMathOperator|makeatletter|hypersetup|newenvironment|let)\b"
PARAMETER = r"#\d"
DIMENSION = r"(?<![\w.])=?\s*\d*\.?\d+\s?(?:pt|em|ex|cm|mm)\b"
INTERNAL = r"@[A-Za-z]{2,}@|\bplus\s*-?\d+@"
THEOREM_NAME = r"\b([a-z]{3,8})([A-Z][a-z]+)\b"
#: fixed values: marks of an author block
EMAIL = r"(?:[\w.\-]*(?:\.\.\.)?|\})@[\w\-]+(?:\.[\w\-]+)+|\bE-?mail\s*:"
AFFILIATION = r"\b(?:Universit\w*|Institut\w*|Laborator\w*|Department|School of|College|Academy|Research|Inc\.|Ltd\.?|GmbH|Corporation|Google|Microsoft|Meta AI)\b"
CAPITALIZED = r"\b[A-Z][a-z]+\b"
TITLE_RULE = r"={20,}|\*{5,}"


def _n(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def _present(c: Column, patterns: tuple[str, ...]) -> Column:
    """How many of the patterns occur."""
    return reduce(lambda a, b: a + b, [c.rlike(p).cast("int") for p in patterns])


def reasons(text: Column, title: Column | None = None) -> dict[str, Column]:
    """By name, the rules that say a chunk has no content. All but the first two ask for few function words, which prose has."""
    t = F.trim(F.coalesce(text, F.lit("")))
    share, words = stop_word_ratio(t), _n(t, "[A-Za-z]+")
    names = F.arrays_zip(F.regexp_extract_all(t, F.lit(THEOREM_NAME), F.lit(1)).alias("short"), F.regexp_extract_all(t, F.lit(THEOREM_NAME), F.lit(2)).alias("long"))
    flat = F.size(F.filter(names, lambda x: F.lower(x["long"]).startswith(x["short"])))
    macros = 2 * _n(t, MACRO) + _n(t, PARAMETER)
    clean = F.trim(F.regexp_replace(F.coalesce(title if title is not None else F.lit(""), F.lit("")), TITLE_NOISE, ""), F.lit(" .:*"))
    bare = {
        "bibliography": ((_present(t, BIBLIOGRAPHY) >= 3) & (share < 0.22)) | ((share < 0.1) & t.rlike(ENTRY_LABEL)),
        "venue": t.rlike(VENUE_SURE) | (_present(t, VENUE) >= 2),
        "preamble": ((macros >= 3) & (share < 0.15)) | ((macros + _n(t, DIMENSION) >= 4) & (share < 0.08)) | (_n(t, INTERNAL) >= 2) | (flat >= 3),
        "title_block": (F.length(t) < 800) & t.rlike(TITLE_RULE),
        "authors": (t.rlike(EMAIL) & (share < 0.2)) | ((share < 0.12) & (_n(t, AFFILIATION) >= 2) & (words > 0) & (_n(t, CAPITALIZED) > 0.4 * words)),
    }
    labels = reduce(lambda a, b: a + b, [t.contains(x).cast("int") for x in CHECKLIST])
    return {
        "section": (t != "") & clean.rlike(JUNK_TITLE),
        "checklist": t.contains(CHECKLIST[2]) & (labels >= 2),
        **{k: (t != "") & (share < 0.25) & v for k, v in bare.items()},
    }


def boilerplate(text: Column, title: Column | None = None, element: Column | None = None) -> Column:
    """A chunk without content of its own; protected elements and empty texts are not judged."""
    found = reduce(lambda a, b: a | b, reasons(text, title).values())
    return found if element is None else found & ~F.coalesce(element.isin(*PROTECTED), F.lit(False))
