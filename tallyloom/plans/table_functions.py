"""Table functions for SQL: hits of personal data and entities of one text, cells of one page of words.

After ``register(spark)``::

    SELECT d.doc_id, h.* FROM documents d, LATERAL pii_hits(d.text) h
    SELECT * FROM page_cells(TABLE(SELECT page, x, y, width, text, confidence FROM words) PARTITION BY page)

A page is a partition of its own, so that Spark deals pages over the tasks and a task holds one at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from ..operators import privacy, text

HITS = "kind string, value string, first int, last int, confidence double"
ENTITIES = "kind string, text string, first int, last int"
CELLS = "page long, row_no int, col_no int, text string, confidence double"
#: How far a word may be from the mean of its row, and starts from each other in one column.
ROW_GAP, COLUMN_GAP = 15.0, 30.0


class PiiHits:
    """Every hit in a text; none in a null one."""

    def __init__(self):
        self.found = [(k, re.compile(p), c) for k, p, c in privacy.PATTERNS]

    def eval(self, said: str) -> Iterator[tuple]:
        for k, p, c in self.found:
            for m in p.finditer(said or ""):
                yield k, m.group(), m.start(), m.end(), c


class Entities:
    """Numbers, dates, operators and quoted values of a text by their places."""

    def eval(self, said: str) -> Iterator[tuple]:
        found = [(m.start(), k, m.group(0), m.end()) for k, p in text._SPANS for m in p.finditer(said or "")]
        for first, kind, value, last in sorted(found, key=lambda x: x[:2]):
            yield kind, value, first, last


class PageCells:
    """Rows by the running mean of y, columns by clusters of starts, words of a cell from left to right."""

    def __init__(self):
        self.words: list[tuple] = []
        self.page = None

    def eval(self, row: Row) -> None:
        self.page = row["page"]
        self.words.append((row["y"], row["x"], row["width"], row["text"], row["confidence"]))

    def terminate(self) -> Iterator[tuple]:
        starts, bounds = sorted({w[1] for w in self.words}), []
        cluster: list[float] = []
        for x in starts:
            if cluster and x - cluster[-1] > COLUMN_GAP:
                bounds.append(sum(cluster) // len(cluster))
                cluster = []
            cluster.append(x)
        if cluster:
            bounds.append(sum(cluster) // len(cluster))
        cells: dict[tuple, list] = {}
        row, total, n = 0, 0.0, 0
        for y, x, width, said, confidence in sorted(self.words, key=lambda w: w[:2]):
            if n and abs(y - total / n) > ROW_GAP:
                row, total, n = row + 1, 0.0, 0
            total, n = total + y, n + 1
            column = max(0, sum(b <= x + width // 2 for b in bounds) - 1)
            cells.setdefault((row, column), []).append((x, said, confidence))
        for (r, c), held in sorted(cells.items()):
            yield self.page, r, c, " ".join(w[1] for w in sorted(held, key=lambda w: w[:2])), sum(w[2] for w in held) / len(held)


def register(spark: SparkSession) -> None:
    """pii_hits(text), entities(text) and page_cells(TABLE(...) PARTITION BY page) for the session's SQL."""
    spark.udtf.register("pii_hits", udtf(PiiHits, returnType=HITS))
    spark.udtf.register("entities", udtf(Entities, returnType=ENTITIES))
    spark.udtf.register("page_cells", udtf(PageCells, returnType=CELLS))
