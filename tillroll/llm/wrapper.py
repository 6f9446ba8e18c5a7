"""Main text of web pages by wrapper induction over the pages of a host.

Every page is parsed once into its skeleton and text blocks (`html_tree`), staged. A host's
commonest skeleton is its reference; every page of the host is aligned to it by simple tree
matching, so a block stands in a slot of the host's template (or, where nothing matches, in one
named by its tag path). A text that most pages of the host repeat in one slot is part of the
template; slots whose text varies are content. Page furniture that the markup names (menus, adverts
and so on) never is, and where a page marks its article, slots outside are not its text.

Pages of equal blocks count once, so copies of one article do not turn its text into template. All counts are over all pages and pre-aggregated per task; a host sends back only its
constant texts, of which a page has at most as many as blocks. No host is gathered in one task.

Cases: null or empty html: empty text; null url, or one without a host: no host to compare with,
the markup alone decides; repeated rows are extracted alike and count once; one or two pages: no
template, as two pages that share a text cannot tell template from quote; other columns are
carried in one struct, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.html_tree import Matcher, Page
from tillroll.llm.tokens import slices
from tillroll.plans.staging import stage

#: a text is constant if it is on as many pages as this share of those that fill its slot, on LEAST
#: at least, and on half of the latter in the slot itself
CONSTANT = 0.8
LEAST = 3
_SLICE = 2 << 20
_ALIGNED = 2000


def host_of(url: Column) -> Column:
    """Lower-case host of a url, without user and port; empty if there is none."""
    found = F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(F.lower(found), F.lit(""))


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def parsed(pages: DataFrame, carry: list[str], url: str, html: str) -> DataFrame:
    """(page, host, skeleton, key, nodes, hashes, texts) of every page, staged."""
    chosen = pages.select(
        F.struct(*(F.col(f"`{c}`") for c in carry)).alias("page"),
        host_of(F.col(f"`{url}`")).alias("host"),
        F.col(f"`{html}`").alias("html"),
    )
    kind = chosen.schema["page"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, _SLICE):
            out = []
            for html in batch.column(2):
                page = Page(html.as_py() or "")
                skeleton, place = page.skeleton()
                marked = any(b[2] for b in page.blocks)
                # in a page that marks no article, blocks of links alone are menus
                blocks = [b for b in page.blocks if (b[2] if marked else not b[3])]
                texts = [b[1] for b in blocks]
                key = _hash("\0".join(texts))
                out.append((skeleton, key, [place[b[0]] for b in blocks], [_hash(t) for t in texts], texts))
            types = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string())]
            made = (pa.array(c, t) for c, t in zip(zip(*out), types))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *made],
                names=["page", "host", "skeleton", "key", "nodes", "hashes", "texts"],
            )

    made = chosen.mapInArrow(
        run,
        f"page {kind}, host string, skeleton string, key bigint, nodes array<int>, "
        "hashes array<bigint>, texts array<string>",
    )
    return stage(made, "parsed-pages")


def references(pages: DataFrame) -> DataFrame:
    """(host, reference): the commonest skeleton of each host; of equal ones the longer."""
    counted = pages.filter("host <> ''").groupBy("host", "skeleton").agg(F.count("*").alias("n"))
    order = F.struct("n", F.length("skeleton"), "skeleton")
    return stage(counted.groupBy("host").agg(F.max_by("skeleton", order).alias("reference")), "references")


class _Slots:
    """Slot of every node of a skeleton: its node of the reference, else its hashed tag path."""

    def __init__(self):
        self._forget()

    def _forget(self) -> None:
        self.matcher, self.found, self.read = Matcher(), {}, {}

    def _skeleton(self, written: str):
        if written not in self.read:
            self.read[written] = self.matcher.read(written)
        return self.read[written]

    def of(self, skeleton: str, reference: str) -> list[int]:
        slots = self.found.get((skeleton, reference))
        if slots is None:
            if len(self.found) >= _ALIGNED:
                self._forget()
            own = self._skeleton(skeleton)
            places = self.matcher.align(own, self._skeleton(reference))
            slots = [p if p >= 0 else -1 - abs(_hash(path)) // 2 for p, path in zip(places, own.paths())]
            self.found[skeleton, reference] = slots
        return slots


def templates(
    pages: DataFrame, references: DataFrame, constant: float = CONSTANT, least: int = LEAST
) -> DataFrame:
    """(host, constant): the texts (slot, text) that a host's pages repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots()
        for batch in batches:
            host, skeleton, key, nodes, hashes, reference = (c.to_pylist() for c in batch.columns)
            out = set()
            for i in range(len(host)):
                at = slots.of(skeleton[i], reference[i])
                out.update((host[i], at[n], h, key[i]) for n, h in zip(nodes[i], hashes[i]))
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
            made = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, types)]
            yield pa.RecordBatch.from_arrays(made, names=["host", "slot", "text", "key"])

    fields = pages.join(references, "host").select("host", "skeleton", "key", "nodes", "hashes", "reference")
    seen = fields.mapInArrow(run, "host string, slot bigint, text bigint, key bigint")
    seen = stage(seen.distinct(), "slot-texts")
    filled = seen.select("host", "slot", "key").distinct()
    filled = filled.groupBy("host", "slot").agg(F.count("*").alias("pages"))
    # a text may stand in other slots on pages of another layout: those pages count too
    anywhere = seen.select("host", "text", "key").distinct()
    anywhere = anywhere.groupBy("host", "text").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    here = seen.groupBy("host", "slot", "text").agg(F.count("*").alias("here"))
    same = here.join(anywhere, ["host", "text"]).join(filled, ["host", "slot"])
    same = same.filter(
        (F.col("n") >= constant * F.col("pages")) & (2 * F.col("here") >= F.col("pages"))
    )
    return stage(same.groupBy("host").agg(F.collect_list(F.struct("slot", "text")).alias("constant")), "templates")


def extract(
    pages: DataFrame,
    url: str = "url",
    html: str = "html",
    carry: list[str] | None = None,
    constant: float = CONSTANT,
    least: int = LEAST,
) -> DataFrame:
    """(page, text, n_chars) of every row; ``page`` is the row, or its columns ``carry``."""
    found = parsed(pages, carry or pages.columns, url, html)
    reference = references(found)
    constant_texts = templates(found, reference, constant, least)
    kind = found.schema["page"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots()
        for batch in batches:
            skeleton, nodes, hashes, texts, reference, template = (
                c.to_pylist() for c in batch.columns[1:]
            )
            out = []
            for i, own in enumerate(texts):
                if template[i]:
                    known = {(t["slot"], t["text"]) for t in template[i]}
                    at = slots.of(skeleton[i], reference[i])
                    own = [t for t, n, h in zip(own, nodes[i], hashes[i]) if (at[n], h) not in known]
                out.append("\n\n".join(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())],
                names=["page", "text", "n_chars"],
            )

    # both sides are as small as the hosts and their constant texts; Spark measures them
    whole = found.join(reference, "host", "left").join(constant_texts, "host", "left")
    return whole.select("page", "skeleton", "nodes", "hashes", "texts", "reference", "constant").mapInArrow(
        run, f"page {kind}, text string, n_chars bigint"
    )
