"""Lists and structured data in web pages. Each page is parsed in its task by the standard library's parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .nested import ListedSongs, each

#: Page parts whose lists are not tracklists.
SKIPPED = frozenset({"nav", "footer", "header", "aside", "script", "style"})


class _Lists(HTMLParser):
    def __init__(self, skipped: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.skipped = skipped
        self.skip, self.open, self.done, self.text = 0, [], [], None

    def handle_starttag(self, tag, attrs):
        if tag in self.skipped:
            self.skip += 1
        elif self.skip:
            return
        elif tag in ("ol", "ul", "table"):
            self.open.append([])
        elif tag in ("li", "tr") and self.open:
            self._item()
            self.text = []
        elif tag in ("td", "th", "br") and self.text:
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in self.skipped:
            self.skip = max(0, self.skip - 1)
        elif self.skip:
            return
        elif tag in ("li", "tr"):
            self._item()
        elif tag in ("ol", "ul", "table") and self.open:
            self._item()
            self.done.append(self.open.pop())

    def handle_data(self, data):
        if self.text is not None and not self.skip:
            self.text.append(data)

    def _item(self):
        if self.text is not None and self.open:
            text = " ".join("".join(self.text).split())
            if 4 <= len(text) <= 299:
                self.open[-1].append(text)
        self.text = None


def tracklists(pages: DataFrame, least: int = 2, most: int = 500, skipped: frozenset[str] = SKIPPED) -> DataFrame:
    """page_id, list_no, pos, text: items of lists and tables outside the skipped parts, of lists of allowed length."""

    def run(batches):
        for b in batches:
            out = []
            for page, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p = _Lists(skipped)
                p.feed(html or "")
                kept = [x for x in p.done if least <= len(x) <= most]
                out += [(page, n, i, t) for n, x in enumerate(kept) for i, t in enumerate(x)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["page_id", "list_no", "pos", "text"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, list_no int, pos int, text string")


def json_ld(pages: DataFrame) -> DataFrame:
    """page_id, pos (in its list), name, artist of the tracks of playlists, albums and item lists in JSON-LD, wherever they
    stand in it; a track without artist takes the list's."""
    body = F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1))
    return each(pages.select("page_id", body.alias("body")), ["page_id"], F.col("body"), ListedSongs).select("page_id", "pos", "name", "artist")
