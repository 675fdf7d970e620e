"""Column functions on text. Patterns are ASCII classes, so that other engines agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: words left out of an any-word query
QUERY_STOP_WORDS = (
    "a an and are as at be been but by can do does for from has have how in into is it its of on or our such that the "
    "their them then there these they this to use used uses using was we were what when where which while who why will "
    "with within without you your"
).split()
#: fixed values: words whose share tells prose from lists
PROSE_STOP_WORDS = (
    "the of and to in is are we a an that for on with as by this it be from which can our these such not or at was were "
    "has have been their its also than more but into using used use between each both where when how while over under"
).split()
#: fixed values: words left out of title comparisons
TITLE_STOP_WORDS = "a an the of in on for and or to with via from by at as is are its their our using towards toward".split()


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def query_words(c: Column) -> Column:
    """Words of a query, hyphens inside kept, in order."""
    return F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9][A-Za-z0-9\-]*"), F.lit(0))


def all_words_query(c: Column, most: int = 12) -> Column:
    """The words that must all occur: the first `most` longer than one letter, in lower case."""
    return F.slice(F.transform(F.filter(query_words(c), lambda w: F.length(w) > 1), F.lower), 1, most)


def any_words_query(c: Column, most: int = 16) -> Column:
    """The words of which any may occur: the first `most` different content words longer than two letters."""
    return F.slice(F.array_distinct(F.filter(F.transform(query_words(c), F.lower), lambda w: (F.length(w) > 2) & ~w.isin(QUERY_STOP_WORDS))), 1, most)


def title_key(c: Column) -> Column:
    """Lower case, anything but letters and digits one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def title_tokens(c: Column) -> Column:
    """Distinct words of a title, stop words aside."""
    return F.filter(F.array_distinct(F.split(title_key(c), " ")), lambda w: (w != "") & ~w.isin(TITLE_STOP_WORDS))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return both / F.greatest(F.lit(1), F.size(a) + F.size(b) - both)


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))


def numeric_density(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^0-9]", "")) / F.greatest(F.lit(1), F.length(c))


def stop_word_ratio(c: Column) -> Column:
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: w.isin(PROSE_STOP_WORDS))) / F.size(words)).otherwise(0.0)


def html_to_text(c: Column) -> Column:
    """Scripts, styles and page furniture go with their content, other tags for a space; blanks are squeezed."""
    for tag in ("script", "style", "nav", "footer", "header"):
        c = F.regexp_replace(c, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    c = F.regexp_replace(c, "(?s)<[^>]+>", " ")
    return F.regexp_replace(F.regexp_replace(c, "&nbsp;?", " "), r"[ \t]+", " ")


def normalize_pdf(c: Column) -> Column:
    """Hyphenated line ends join, lines of a paragraph join, paragraphs stay."""
    c = F.regexp_replace(c, r"([A-Za-z0-9_])-\s*\n\s*([A-Za-z0-9_])", "$1$2")
    paragraphs = F.transform(F.split(c, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"\s*\n\s*", " "), r"[ \t]{2,}", " ")))
    return F.array_join(F.filter(paragraphs, lambda p: p != ""), "\n\n")


def clip(c: Column, limit: int) -> Column:
    """At most `limit` characters, cut at the last space before, with an ellipsis."""
    head = F.substring(c, 1, limit)
    cut = F.regexp_replace(head, r"\s+\S*\z", "")
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(cut, F.lit("…")))


def sentence_truncate(c: Column, limit: int) -> Column:
    """At most `limit` characters: to the last sentence end beyond 40 % of them, else to the last space."""
    head = F.substring(c, 1, limit)
    sentence = F.regexp_extract(head, r"(?s)^(.*[.!?])(?:\s|$)", 1)
    word = F.regexp_extract(head, r"(?s)^(.*)\s", 1)
    return F.when(F.length(c) <= limit, c).when(F.length(sentence) > 0.4 * limit, sentence).otherwise(F.when(F.length(word) > 0, word).otherwise(head))


def source_of(doc_id: Column) -> Column:
    """The prefix of an identifier before its first colon, or arxiv without one."""
    return F.when(doc_id.contains(":"), F.substring_index(doc_id, ":", 1)).otherwise(F.lit("arxiv"))


def term_key(c: Column) -> Column:
    """A vocabulary key: case, separators and a plural s do not count."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.regexp_replace(w, "s$", "")).otherwise(w)), "")


def string_list(c: Column) -> Column:
    """A JSON list of strings; anything else is an empty list, other members go, repeated ones count once."""
    return F.coalesce(F.array_distinct(F.filter(F.from_json(c, "array<string>"), lambda x: x.isNotNull())), F.array().cast("array<string>"))


def section_type(title: Column) -> Column:
    """The first pattern that a section title matches decides; `other` without one."""
    #: fixed values: patterns in order of precedence
    rules = [
        ("appendix", r"(?i)\b(proof|proofs|lemma|theorem|corollary|derivation|derivations)\b"),
        ("appendix", r"(?i)appendix|supplement"),
        ("limitations", r"(?i)limitation|threat|weakness"),
        ("related_work", r"(?i)related|prior work|literature"),
        ("conclusion", r"(?i)conclu|future work|summary"),
        ("introduction", r"(?i)introduc|overview|motivation"),
        ("analysis", r"(?i)analysis|discussion|ablation"),
        ("experiments", r"(?i)experiment|evaluation|result|benchmark|empirical|dataset|setup"),
        ("method", r"(?i)method|approach|model|architecture|algorithm|methodology|framework|system|proposed|design|network"),
    ]
    out = F.lit(None).cast("string")
    for name, pattern in rules:
        out = F.coalesce(out, F.when(title.rlike(pattern), F.lit(name)))
    return F.coalesce(out, F.lit("other"))


def title_overlap(query: Column, title: Column) -> Column:
    """The share of a query's different words that a title has."""
    q = F.array_distinct(tokens(query))
    return F.size(F.array_intersect(q, tokens(title))) / F.greatest(F.lit(1), F.size(q))


def stems(c: Column, n: int = 5) -> Column:
    """Different content words cut to n letters."""
    return F.array_distinct(F.transform(F.filter(tokens(c), lambda w: (F.length(w) > 3) & ~w.isin(QUERY_STOP_WORDS)), lambda w: F.substring(w, 1, n)))


def cursor(offset: Column, page: Column) -> Column:
    """A base64url cursor of JSON with sorted keys."""
    return F.translate(F.base64(F.concat(F.lit('{"offset":'), offset.cast("string"), F.lit(',"page":'), page.cast("string"), F.lit("}")).cast("binary")), "+/", "-_")


def cursor_of(c: Column) -> Column:
    return F.from_json(F.unbase64(F.translate(c, "-_", "+/")).cast("string"), "offset long, page long")


def word_overlap(left: Column, right: Column) -> Column:
    """Words of the longest suffix of one passage that begins the next.

    The passages' words are compared as strings ended by spaces: a suffix is tried only where the next passage's first
    word stands, so the work grows with how often that word occurs, and whole strings are compared there.
    """
    a, b = F.split(F.trim(left), r"\s+"), F.split(F.trim(right), r"\s+")
    start = F.concat(F.array_join(b, " "), F.lit(" "))
    places = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (F.get(a, i) == F.get(b, 0)) & (F.size(a) - i <= F.size(b)))
    fits = F.filter(places, lambda i: start.startswith(F.concat(F.array_join(F.slice(a, i + 1, F.size(a)), " "), F.lit(" "))))
    return F.coalesce(F.size(a) - F.array_min(fits), F.lit(0))


def source_label(doc_id: Column) -> Column:
    #: fixed values: labels of sources by identifier prefix
    labels = {"arxiv": "arXiv", "iacr": "IACR ePrint", "acl": "ACL Anthology", "eip": "Ethereum EIPs", "hal": "HAL", "oa": "OpenAlex", "pmlr": "PMLR"}
    out = F.lit("other")
    for k, v in labels.items():
        out = F.when(source_of(doc_id) == k, F.lit(v)).otherwise(out)
    return out


def occurrences(c: Column, target: str) -> Column:
    """How often `target` begins in a text, overlaps included."""
    n = len(target)
    return F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - n + 1)), lambda i: F.substring(c, i, F.lit(n)) == target))


def project_key(doc_id: Column) -> Column:
    """The project of a framework document's identifier (gh:project:path); null for others."""
    parts = F.split(doc_id, ":")
    return F.when((F.size(parts) > 2) & (F.get(parts, 0) == "gh"), F.get(parts, 1))


def moved_stub(c: Column) -> Column:
    """A short text that only says that its subject moved elsewhere."""
    return (F.length(c) <= 600) & c.rlike(r"(?i)\b(has|was) moved to\b|\bthis (page|eip|document) (has )?moved\b|^status: moved")


def foreign_scope(c: Column, anchors: list[str], domains: dict[str, str]) -> Column:
    """The first foreign domain whose pattern a query matches, unless it names an anchor of our own."""
    low = F.lower(c)
    own = low.rlike("(^|[^a-z0-9])(" + "|".join(anchors) + ")($|[^a-z0-9])")
    out = F.lit(None).cast("string")
    for name, pattern in reversed(domains.items()):
        out = F.when(low.rlike(pattern), F.lit(name)).otherwise(out)
    return F.when(~own, out)


def same_opening(a: Column, b: Column, n: int = 100) -> Column:
    """Two texts begin with the same n characters of their keys."""
    return F.coalesce(F.length(title_key(a)) >= n, F.lit(False)) & (F.left(title_key(a), F.lit(n)) == F.left(title_key(b), F.lit(n)))


def corroborated(title_a: Column, title_b: Column, abs_a: Column, abs_b: Column) -> Column:
    """Titles share half of their words, or abstracts begin alike: what an identifier found in an address needs beside it."""
    return F.coalesce(jaccard(title_tokens(title_a), title_tokens(title_b)) >= 0.5, F.lit(False)) | F.coalesce(same_opening(abs_a, abs_b), F.lit(False))


def vector_sha256(v: Column) -> Column:
    """The content hash of a vector's values as 32-bit floats: each written in the shortest way that reads back as the same float."""
    return F.sha2(F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: (x.cast("float") + F.lit(0).cast("float")).cast("string")), ","), F.lit("]")), 256)


def unescaped(c: Column) -> Column:
    """HTML entities of common characters turned back, each once."""
    #: fixed values: entities and what they stand for; the ampersand's comes last
    entities = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}
    for name, letter in entities.items():
        c = F.replace(c, F.lit(name), F.lit(letter))
    return c


def sha1_bucket(c: Column, buckets: int) -> Column:
    """The SHA-1 of a text as one number, modulo `buckets`: digit by digit, so that no number outgrows a long."""
    digits = F.transform(F.split(F.sha1(c), ""), lambda x: F.call_function("instr", F.lit("0123456789abcdef"), x) - 1)
    return F.aggregate(digits, F.lit(0), lambda a, x: F.pmod(a * 16 + x, F.lit(buckets)))


def embed_text(title: Column, abstract: Column, fallback: Column, least: int = 80) -> Column:
    """What stands for a document: its title, and its abstract if that has `least` characters, else its fallback chunk if there is one."""
    long_enough = F.length(F.trim(abstract)) >= least
    return F.concat_ws("\n", title, F.when(long_enough, F.trim(abstract)).otherwise(fallback))
