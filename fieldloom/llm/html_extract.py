"""Main text of web pages by line-block distribution.

The page is stripped to lines, one for each block element. A line inside a menu, header, footer, sidebar, notice, advert,
form or comment container counts as blank, as does one that is mostly links. Text lengths are summed over a sliding
window of lines; the core begins at the first surge of that sum and ends at its last dive (of equal worth are all lines
where no window reaches ``SURGE`` characters).

On every page the core decides. Marks of articles are evidence for its edges alone: where a marked element (the innermost
of those that hold most of the core's text) holds more than half of the core, the text goes from that element's first line
to its last, so short lines at its edges are kept and other marked elements, such as teasers of other articles, are not.
Elsewhere the core itself is kept. Blank lines are left out.

Defined results: null, empty or text-free html gives the empty text; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from fieldloom.llm.html_blocks import Block, scan
from fieldloom.llm.text_kernel import relieved

WINDOW = 3
SURGE = 60
LINKS = 0.6
#: Of the text that the fullest marked element holds; inner elements that hold as much are the article.
SHARE = 0.8
SCHEMA = "page_id long, url string, text string, n_chars long, n_lines int, surge int, dive int"


def line_lengths(lines: list[Block]) -> list[int]:
    """Text length of each line, 0 for a blank one."""
    return [0 if x.boiler or x.link_chars >= LINKS * len(x.text) else len(x.text) for x in lines]


def surge_and_dive(lengths: list[int], least: int, window: int = WINDOW) -> tuple[int, int]:
    """First line of the first window whose sum reaches ``least``, and the line after the last such window's last text."""
    sums, total = [], 0
    for i, n in enumerate(lengths):
        total += n - (lengths[i - window] if i >= window else 0)
        sums.append(total)  # of the window that ends at line i
    hot = [i for i, s in enumerate(sums) if s >= least]
    if not hot:
        return (0, len(lengths)) if any(lengths) else (0, 0)  # no line block stands out: all text there is
    return max(0, hot[0] - window + 1), min(hot[-1] + 1, len(lengths))


def marked_element(lines: list[Block], lengths: list[int]) -> int | None:
    """The innermost marked element that holds most of the text, if that is more than half of it."""
    held: Counter[int] = Counter()
    for x, n in zip(lines, lengths, strict=True):
        for mark in x.articles:
            held[mark] += n
    most = max(held.values(), default=0)
    if 2 * most <= sum(lengths):
        return None
    return max(mark for mark, n in held.items() if n >= SHARE * most)  # numbers rise inwards


def extract(html: str | None) -> tuple[str, int, int, int]:
    """Main text, number of lines, surge line and dive line."""
    lines = scan(html).blocks if html else []
    lengths = line_lengths(lines)
    lo, hi = surge_and_dive(lengths, SURGE)
    mark = marked_element(lines[lo:hi], lengths[lo:hi])
    if mark is None:
        kept = [x.text for x, n in zip(lines[lo:hi], lengths[lo:hi], strict=True) if n]
    else:
        kept = [x.text for x in lines if mark in x.articles and not x.boiler]
    return " ".join(kept), len(lines), lo, hi


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``pages(page_id, url, html)``, with the surge and dive lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    batch.column(1).cast(pa.string()),
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([len(x[0]) for x in found], pa.int64()),
                    *(pa.array([x[k] for x in found], pa.int32()) for k in (1, 2, 3)),
                ],
                ["page_id", "url", "text", "n_chars", "n_lines", "surge", "dive"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(relieved(run), SCHEMA)
