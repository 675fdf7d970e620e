"""Documents to chunks: one row in, many out, by Arrow batches; each document by itself."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1700, 0.15
CHUNK = "doc_id long, chunk_index int, section_title string, element_type string, part_index int, part_total int, text string"


#: where a text may be divided, from the best place to the next best: between paragraphs, after sentences
DIVIDES = (re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?])\s+"))


def slices(text: str, limit: int, tail: int) -> list[str]:
    """Parts of `limit` characters, each beginning `tail` before the end of the one before it, as many as reach the end."""
    fresh = limit - tail
    return [text[fresh * k : fresh * k + limit] for k in range(1 + max(0, -(-(len(text) - limit) // fresh)))]


def layout(sizes: list[int], limit: int, tail: int) -> list[tuple[int, int, int]]:
    """How units of these sizes share pieces: (first unit, units, characters taken over from the piece before), by sizes alone.

    A unit beyond the limit has a piece of its own that takes nothing over, and nor does the piece after it.
    """
    out: list[list[int]] = []
    room = -1  # what the last piece can still take; nothing fits a closed one
    for i, n in enumerate(sizes):
        if n > limit:
            out.append([i, 1, 0])
            room = -1
        elif room >= n + 2:
            out[-1][1] += 1
            room -= n + 2
        else:
            before = limit - room if room >= 0 else 0
            take = min(tail, before) if before and n + 2 + min(tail, before) <= limit else 0
            out.append([i, 1, take])
            room = limit - n - (take + 2 if take else 0)
    return [tuple(x) for x in out]


def split_long(text: str, limit: int = LIMIT, overlap: float = OVERLAP) -> list[str]:
    """Pieces of at most `limit` characters at paragraphs, else sentences, else anywhere; each takes up the tail of the one before."""
    if len(text) <= limit:
        return [text]
    tail, units = int(limit * overlap), []
    for divide in DIVIDES:
        units = [u for u in divide.split(text) if u.strip()]
        if len(units) > 1:
            break
    else:
        return slices(text, limit, tail)
    out: list[str] = []
    for first, n, take in layout([len(u) for u in units], limit, tail):
        body = "\n\n".join(units[first : first + n])
        out += slices(body, limit, tail) if len(body) > limit else ["\n\n".join([out[-1][-take:], body]) if take else body]
    return out


def pack_paragraphs(text: str, least: int = 1500, most: int = 3500) -> list[str]:
    """Paragraphs joined until `least` characters are there, as long as no piece is beyond `most`."""
    out: list[str] = []
    held = ""
    for p in (p.strip() for p in re.split(r"\n\s*\n", text)):
        if not p:
            continue
        joined = f"{held}\n\n{p}" if held else p
        if held and (len(held) >= least or len(joined) > most):
            out.append(held)
            joined = p
        held = joined
    return out + [held] * bool(held)


def markdown_elements(text: str) -> list[tuple[str, str, str]]:
    """(section title, element type, text): prose, code fences, display equations and tables, under their nearest headings."""
    out: list[tuple[str, str, str]] = []
    path: list[tuple[int, str]] = []
    prose: list[str] = []

    def title() -> str:
        return " > ".join(t for _, t in path)

    def flush() -> None:
        body = "\n".join(prose).strip()
        if body:
            out.append((title(), "prose", body))
        prose.clear()

    lines, i = text.split("\n"), 0
    while i < len(lines):
        line = lines[i]
        heading = re.match(r"(#{1,6})\s+(.*?)\s*#*$", line)
        fence = re.match(r"\s*(```+|~~~+)", line)
        end = i + 1
        if heading:
            flush()
            level = len(heading[1])
            path[:] = [p for p in path if p[0] < level] + [(level, heading[2].strip("*_ "))]
        elif fence or line.strip().startswith(("$$", "\\[")):
            close = fence[1] if fence else ("$$" if line.strip().startswith("$$") else "\\]")
            flush()
            whole = not fence and close in line.strip()[2:]
            while not whole and end < len(lines) and close not in lines[end]:
                end += 1
            end = end if whole else min(len(lines), end + 1)
            out.append((title(), "code" if fence else "equation", "\n".join(lines[i:end])))
        elif line.lstrip().startswith("|") and i + 1 < len(lines) and re.match(r"\s*\|?[\s:|-]+\|[\s:|-]*$", lines[i + 1]):
            flush()
            while end < len(lines) and lines[end].lstrip().startswith("|"):
                end += 1
            out.append((title(), "table", "\n".join(lines[i:end])))
        else:
            prose.append(line)
        i = end
    flush()
    return out


def latex_elements(text: str) -> list[tuple[str, str, str]]:
    """(section title, element type, text) of LaTeX source: comments go, sections split, environments have types."""
    text = re.sub(r"(?<!\\)%[^\n]*", "", text)
    #: fixed values: environments by the type of element they hold
    kinds = {"equation": "equation", "align": "equation", "gather": "equation", "algorithm": "algorithm", "lstlisting": "code", "verbatim": "code", "table": "table", "tabular": "table", "figure": "figure"}
    environment = re.compile(r"\\begin\{(" + "|".join(kinds) + r")(\*?)\}.*?\\end\{\1\2\}", re.S)
    parts, out = re.split(r"\\(?:sub)*section\*?\{([^}]*)\}", text), []
    for name, body in zip(["", *parts[1::2]], parts[0::2], strict=True):
        at = 0
        for m in environment.finditer(body):
            out += [(name, "prose", body[at : m.start()].strip()), (name, kinds[m[1]], m[0])]
            at = m.end()
        out.append((name, "prose", body[at:].strip()))
    return [x for x in out if x[2]]


def chunk(docs: DataFrame, elements: Callable[[str], list[tuple[str, str, str]]] = markdown_elements, limit: int = LIMIT) -> DataFrame:
    """Chunks of each row of docs (doc_id, text): elements of a text in order, long ones in parts. Null text: none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n = 0
                for title, kind, body in elements(t.as_py() or ""):
                    pieces = split_long(body, limit)
                    for i, piece in enumerate(pieces):
                        rows.append((doc, n, title, kind, i, len(pieces), piece))
                        n += 1
            cols = list(zip(*rows, strict=True)) or [()] * 7
            types = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "chunk_index", "section_title", "element_type", "part_index", "part_total", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, CHUNK)


#: fixed values: a citation command of LaTeX, or numbers in brackets
MARKER = r"\\cite[a-z]*\*?(?:\[[^\]]*\])*\{[^}]*\}|\[[0-9]+(?:, ?[0-9]+)*\]"


def citation_contexts(docs: DataFrame, width: int = 200, usable: bool = False) -> DataFrame:
    """(doc_id, marker, key, context) for each citation marker and key, repeated ones too: the text on both sides up to the next
    marker, `width` characters at most, the marker itself as [CITE]. marker: its place among the document's, from 0.

    usable: only contexts of 60 to 400 characters and 8 words, the marker aside, that do not begin with an ellipsis.
    """
    x = docs.select("doc_id", F.regexp_extract_all("text", F.lit(f"({MARKER})"), F.lit(1)).alias("marks"), F.split("text", MARKER, -1).alias("parts"))
    x = x.select("doc_id", "parts", F.posexplode("marks").alias("marker", "mark"))
    before, after = F.get("parts", F.col("marker")), F.get("parts", F.col("marker") + 1)
    keys = F.split(F.regexp_replace(F.regexp_replace("mark", r"^\\cite[a-z]*\*?(\[[^\]]*\])*\{", ""), r"[\[\]{}]", ""), r"\s*,\s*")
    x = x.select("doc_id", "marker", keys.alias("keys"), F.right(before, F.lit(width)).alias("before"), F.left(after, F.lit(width)).alias("after"))
    if usable:
        plain = F.trim(F.regexp_replace(F.concat("before", F.lit(" "), "after"), r"\s+", " "))
        x = x.where(F.length(plain).between(60, 400) & (F.size(F.split(plain, " ")) >= 8) & ~plain.rlike("^(…|\\.\\.\\.)"))
    return x.select("doc_id", "marker", F.explode("keys").alias("key"), F.concat("before", F.lit("[CITE]"), "after").alias("context"))
