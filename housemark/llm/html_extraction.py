"""Main text of web pages by a tree-structured graphical model.

Every block element is content or not. An element's state depends on its parent's, and what
is seen of it (tag, names in class, id and role, share of links, amount of text) on both:
one potential for each parent and child, from smoothed counts over labelled pages. Messages
go up the tree and down again (sum-product), which gives each element the marginal
probability of being content, given the whole page. Text of scripts, styles and the like is
never read.

Labelled pages are the examples of ``labelled_pages`` and, from the table itself, a bounded
sample of the pages with exactly one article element: the ``SAMPLE`` different ones of smallest
hash of their address and source.
"""

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from housemark.llm.dom import Page
from housemark.llm.labelled_pages import NAMES, PAGES

SAMPLE = 400
#: All sampled pages together weigh at most this part of the weight of the examples. They are
#: often of one make: from a fifth on, a page of another make kept a form.
SAMPLE_SHARE = 0.1
SMOOTHING = 0.2
#: Letters from which on an element has more text.
AMOUNTS = (1, 25, 120)

_FEATURES = 4
_ONE_ARTICLE = r"(?i)<article[\s/>]"
_KIND_OF = {name: kind for kind, names in NAMES.items() for name in names}

Counts = dict[tuple, float]


def seen(page: Page) -> list[tuple]:
    """Tag, kind of names, share of links and amount of text of each node with all below it."""
    n = len(page.tags)
    letters, linked = [0] * n, [0] * n
    for node, text, links in page.pieces:
        letters[node] += len(text)
        linked[node] += links
    for node in range(n - 1, 0, -1):
        letters[page.parents[node]] += letters[node]
        linked[page.parents[node]] += linked[node]
    return [
        (
            page.tags[node],
            kind_of(page.names[node]),
            round(2 * linked[node] / letters[node]) if letters[node] else -1,
            sum(letters[node] >= x for x in AMOUNTS),
        )
        for node in range(n)
    ]


def kind_of(names: str) -> str:
    """The kind of part that the words of class, id and role speak of; ``""`` if of none."""
    if not names:
        return ""
    words = "".join(
        f" {c.lower()}" if c.isupper() else c if c.isalnum() else " " for c in names
    ).split()
    kinds = [_KIND_OF[w] for w in (*words, names.lower()) if w in _KIND_OF]
    return next((k for k in kinds if k != "content"), kinds[0] if kinds else "")


def article_labels(page: Page) -> list[int] | None:
    """States by the page's only article element, or none if it has none or several.

    What is set apart in it by its tag or by what its names speak of is no content.
    """
    if page.tags.count("article") != 1:
        return None
    states = [0] * len(page.tags)
    for node in range(1, len(states)):
        apart = page.tags[node] in ("nav", "aside", "form", "footer", "dialog")
        apart = apart or kind_of(page.names[node]) not in ("", "content")
        inside = states[page.parents[node]] and not apart
        states[node] = int(page.tags[node] == "article" or inside)
    return states


def example_labels(page: Page) -> list[int]:
    """States of an example page: elements named ``yes`` or ``no`` and those below."""
    states = [0] * len(page.tags)
    for node in range(1, len(states)):
        names = page.names[node].split()
        own = 1 if "yes" in names else 0 if "no" in names else None
        states[node] = states[page.parents[node]] if own is None else own
    return states


def add_counts(counts: Counts, page: Page, states: list[int]) -> None:
    """Count transitions (parent state, state), and each feature's value within them."""
    for node, features in enumerate(seen(page)):
        if node:
            move = (states[page.parents[node]], states[node])
            for key in ((*move, -1, ""), *((*move, i, str(x)) for i, x in enumerate(features))):
                counts[key] = counts.get(key, 0.0) + 1.0


def example_counts() -> Counts:
    counts: Counts = {}
    for source in PAGES:
        page = Page(source)
        add_counts(counts, page, example_labels(page))
    return counts


class Model:
    """Log potentials out of counts."""

    def __init__(self, counts: Counts):
        moves = {(p, s): counts.get((p, s, -1, ""), 0.0) for p in (0, 1) for s in (0, 1)}
        values = [len({k[3] for k in counts if k[2] == i}) + 1 for i in range(_FEATURES)]
        self._moves = {}
        self._unseen = {}
        self._seen = {}
        for (p, s), n in moves.items():
            whole = moves[p, 0] + moves[p, 1] + 2 * SMOOTHING
            self._moves[p, s] = math.log((n + SMOOTHING) / whole)
            for i in range(_FEATURES):
                self._unseen[p, s, i] = math.log(SMOOTHING / (n + SMOOTHING * values[i]))
        for (p, s, i, x), n in counts.items():
            if i >= 0:
                whole = moves[p, s] + SMOOTHING * values[i]
                self._seen[p, s, i, x] = math.log((n + SMOOTHING) / whole)
        self._cache: dict[tuple, tuple] = {}

    def potentials(self, features: tuple) -> tuple:
        """Log potentials of (parent, child) states 00, 01, 10 and 11."""
        found = self._cache.get(features)
        if found is None:
            found = self._cache[features] = tuple(
                self._moves[move]
                + sum(
                    self._seen.get((*move, i, str(x)), self._unseen[(*move, i)])
                    for i, x in enumerate(features)
                )
                for move in ((0, 0), (0, 1), (1, 0), (1, 1))
            )
        return found

    def marginals(self, page: Page) -> list[float]:
        """Probability of being content for each node; the page itself is not content."""
        n = len(page.tags)
        edge = [self.potentials(x) for x in seen(page)]
        below = [[0.0, 0.0] for _ in range(n)]
        up = [(0.0, 0.0)] * n
        for node in range(n - 1, 0, -1):
            a, b = below[node]
            w = edge[node]
            up[node] = _sum(w[0] + a, w[1] + b), _sum(w[2] + a, w[3] + b)
            above = below[page.parents[node]]
            above[0] += up[node][0]
            above[1] += up[node][1]
        from_above = [(0.0, 0.0)] * n
        from_above[0] = (0.0, -math.inf)
        found = [0.0] * n
        for node in range(1, n):
            parent, w = page.parents[node], edge[node]
            p0 = from_above[parent][0] + below[parent][0] - up[node][0]
            p1 = from_above[parent][1] + below[parent][1] - up[node][1]
            d0, d1 = _sum(p0 + w[0], p1 + w[2]), _sum(p0 + w[1], p1 + w[3])
            # Only the difference matters; without this, sums drift down a deep tree.
            most = max(d0, d1)
            from_above[node] = (d0 - most, d1 - most)
            gap = from_above[node][0] + below[node][0] - from_above[node][1] - below[node][1]
            found[node] = 1 / (1 + math.exp(gap)) if gap < 700 else 0.0
        return found

    def text(self, source: str | None) -> str:
        """Blocks of content, joined by line feeds; empty without source or content."""
        page = Page(source or "")
        content = self.marginals(page)
        return "\n".join(text for node, text, _ in page.pieces if content[node] >= 0.5)


def _sum(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def train(pages: DataFrame, url: str, source: str, sample: int = SAMPLE) -> Model:
    """Model of the example pages and of at most ``sample`` different pages of the table.

    These are the pages of smallest hash among those with exactly one article element.
    What comes to the driver is a count for each move and value: tags and kinds of names are
    those of ``dom`` and ``labelled_pages``, the rest are a few steps.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        done: set[int] = set()
        for batch in batches:
            for order, text in zip(*(c.to_pylist() for c in batch.columns)):
                page = Page(text) if order not in done else None
                states = article_labels(page) if page else None
                done.add(order)
                if states is not None:
                    counts: Counts = {}
                    add_counts(counts, page, states)
                    rows += [(order, *key, n) for key, n in counts.items()]
        columns = list(zip(*rows)) or [[]] * 6
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["order", "p", "s", "i", "x", "n"]
        )

    # Only hashes are sorted, and only counts leave the tasks: no page is sent anywhere.
    labelled = pages.where(F.regexp_count(source, F.lit(_ONE_ARTICLE)) == 1).select(
        F.xxhash64(url, source).alias("order"), F.col(source).alias("source")
    )
    last = labelled.select("order").distinct().orderBy("order").limit(sample).agg(F.max("order"))
    chosen = labelled.where(F.col("order") <= F.lit(last.first()[0]))
    keys = ["p", "s", "i", "x"]
    schema = "order long, p int, s int, i int, x string, n double"
    # Copies of a page count once.
    once = chosen.mapInArrow(count, schema).groupBy("order", *keys).agg(F.max("n").alias("n"))
    found = once.groupBy(*keys).agg(F.sum("n").alias("n"))
    return Model(mixed(example_counts(), {(r.p, r.s, r.i, r.x): r.n for r in found.collect()}))


def mixed(examples: Counts, sampled: Counts) -> Counts:
    """Both counts, the sampled ones scaled down to ``SAMPLE_SHARE`` of the others' weight."""
    weights = [sum(n for k, n in c.items() if k[2] < 0) for c in (examples, sampled)]
    scale = min(1.0, SAMPLE_SHARE * weights[0] / weights[1]) if weights[1] else 1.0
    counts = Counter(examples)
    counts.update({k: scale * n for k, n in sampled.items()})
    return dict(counts)


def with_text(
    pages: DataFrame, url: str = "url", source: str = "html", sample: int = SAMPLE
) -> DataFrame:
    """``pages`` plus ``text``, the main text of the whole source; empty if there is none.

    A null, empty or textless source has an empty text; repeated rows have equal ones. An
    existing column ``text`` is replaced. Reads the table twice.
    """
    pages = pages.drop("text")
    names = pages.columns
    model = train(pages, url, source, sample)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.text(x) for x in batch.column(names.index(source)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string())], [*names, "text"]
            )

    return pages.mapInArrow(add, T.StructType([*pages.schema.fields, T.StructField("text", T.StringType())]))
