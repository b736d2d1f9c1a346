"""Pages to anchors: the only stage that crosses into Python, Arrow batch by Arrow batch."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators import markup

# Ship these two modules with the task, so that executors need no installation.
cloudpickle.register_pickle_by_value(markup)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_CONSUMED = {"content", "html", "charset_hint"}
_FOUND = (
    "base_href string, parse_error string, "
    "anchors array<struct<pos:int,href:string,title:string,path:array<struct<tag:string,attributes:map<string,string>>>>>"
)
_ELEMENT = pa.struct([("tag", pa.string()), ("attributes", pa.map_(pa.string(), pa.string()))])
_ANCHOR = pa.struct([("pos", pa.int32()), ("href", pa.string()), ("title", pa.string()), ("path", pa.list_(_ELEMENT))])


def _anchors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the page text by what was found in it; all other columns pass through untouched."""
    for batch in batches:
        html = batch.column("html")
        content = batch.column("content") if "content" in batch.schema.names else None
        hint = batch.column("charset_hint") if "charset_hint" in batch.schema.names else None
        selector, skip = batch.column("selector"), batch.column("skip_navigation")
        bases, errors, offsets, found = [], [], [0], []
        for i in range(batch.num_rows):
            base = error = None
            page = html[i].as_py()
            first = len(found)
            try:
                if page is None and content is not None and content[i].is_valid:
                    page = markup.decode_page(content[i].as_py(), hint[i].as_py() if hint is not None else None)
                if page is not None:
                    base, anchors = markup.find_anchors(page, bool(skip[i].as_py()), bool(selector[i].as_py()))
                    found += anchors
            except Exception as failure:  # whatever a page does, it is that page's row that says so
                base, error = None, type(failure).__name__
                del found[first:]
            bases.append(base)
            errors.append(error)
            offsets.append(len(found))
        orders, hrefs, titles, paths = zip(*found, strict=True) if found else ((), (), (), ())
        # An element is a pair already; its attributes become pairs too.
        paths = [[{"tag": tag, "attributes": list(attrs.items())} for tag, attrs in path] for path in paths]
        rows = [pa.array(orders, pa.int32()), pa.array(hrefs, pa.string()), pa.array(titles, pa.string()), pa.array(paths, pa.list_(_ELEMENT))]
        anchors = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(rows, fields=list(_ANCHOR)))
        kept = [name for name in batch.schema.names if name not in _CONSUMED]
        yield pa.RecordBatch.from_arrays(
            [batch.column(name) for name in kept] + [pa.array(bases, pa.string()), pa.array(errors, pa.string()), anchors],
            names=kept + ["base_href", "parse_error", "anchors"],
        )


def parse_pages(pages: DataFrame) -> DataFrame:
    """Add ``base_href``, ``parse_error`` and ``anchors``; drop the page text.

    Needs ``html`` (or ``content`` with ``charset_hint``), ``selector`` and ``skip_navigation``. Select only the
    columns wanted later beforehand: Catalyst cannot prune through this stage.
    """
    if "html" not in pages.columns:
        pages = pages.withColumn("html", F.lit(None).cast("string"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name not in _CONSUMED)
    return pages.mapInArrow(_anchors_of, f"{kept}, {_FOUND}")
