"""HTML as a structure: nodes, table grids and math of each page, within limits, and their text for search."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NODE = "page_id long, node int, parent int, depth int, tag string, grid_row int, grid_col int, text string, truncated boolean"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style template noscript".split())


class _Nodes(HTMLParser):
    """Elements in document order with their own text; cells have their place in the table's grid, spans counted."""

    def __init__(self, most_nodes: int, most_depth: int):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        self.grids: list[dict] = []
        self.most_nodes, self.most_depth, self.truncated = most_nodes, most_depth, False

    def handle_starttag(self, tag, attrs):
        if len(self.rows) >= self.most_nodes or len(self.open) >= self.most_depth:
            self.truncated = True
            return
        row = col = None
        if tag == "table":
            self.grids.append({"row": -1, "taken": set()})
        elif tag == "tr" and self.grids:
            self.grids[-1]["row"] += 1
        elif tag in ("td", "th") and self.grids:
            g, a = self.grids[-1], dict(attrs)
            row, col = max(0, g["row"]), 0
            while (row, col) in g["taken"]:
                col += 1
            size = [min(100, int(v)) if (v := a.get(k) or "1").isdigit() and int(v) > 0 else 1 for k in ("rowspan", "colspan")]
            g["taken"].update((row + i, col + j) for i in range(size[0]) for j in range(size[1]))
        self.rows.append([len(self.rows), self.open[-1] if self.open else -1, len(self.open), tag, row, col, []])
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.rows[self.open[i]][3] == tag), None)
        if at is not None:
            for n in self.open[at:]:
                if self.rows[n][3] == "table" and self.grids:
                    self.grids.pop()
            del self.open[at:]

    def handle_data(self, data):
        if self.open and data.strip() and self.rows[self.open[-1]][3] not in HIDDEN:
            self.rows[self.open[-1]][6].append(" ".join(data.split()))


def nodes(pages: DataFrame, most_nodes: int = 20_000, most_depth: int = 200, most_chars: int = 4 << 20) -> DataFrame:
    """A row for each element of each page (page_id, html); `truncated` where a limit cut the page. Null html: none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page, h in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                html = h.as_py() or ""
                p = _Nodes(most_nodes, most_depth)
                p.feed(html[:most_chars])
                p.close()
                cut = p.truncated or len(html) > most_chars
                out += [(page, *r[:6], " ".join(r[6]), cut) for r in p.rows]
            cols = list(zip(*out, strict=True)) or [()] * 9
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["page_id", "node", "parent", "depth", "tag", "grid_row", "grid_col", "text", "truncated"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(run, NODE)


def search_text(found: DataFrame, most_chars: int = 8000) -> DataFrame:
    """(page_id, text): the nodes' texts in order, cells of a row divided by bars, as far as the budget of characters goes."""
    x = found.where("text <> ''").withColumn("size", F.length("text") + 1)
    used = F.sum("size").over(W.partitionBy("page_id").orderBy("node").rowsBetween(W.unboundedPreceding, 0))
    x = x.withColumn("used", used).where(F.col("used") <= most_chars)
    part = F.struct("node", F.when(F.col("tag").isin("td", "th"), F.concat("text", F.lit(" |"))).otherwise(F.col("text")).alias("t"))
    return x.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda s: s["t"]), " ").alias("text"))
