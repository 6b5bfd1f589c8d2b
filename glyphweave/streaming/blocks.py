"""S10 as a stream: pages to blocks with the open block as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "next int, block long, page int, text string, opened boolean, waiting array<struct<page:int,text:string>>"


def block_stream(pages: DataFrame, first: int = 5, end: str = "}", patience_ms: int = 60_000, book: str = "book") -> DataFrame:
    """Pages (book, page, text) as blocks (book, block, page, text) as ingest.accumulate_pages() makes them, however the pages are cut into micro-batches.

    A book's state is its open block, the page that comes next and pages that came before their turn. When nothing has come for patience_ms the book counts as
    whole: waiting pages are taken in order, whatever is missing between them, and the open block is given out. A page that comes after its
    turn is an error, since its block is out already; so is one that comes twice.
    """
    out = T.StructType([T.StructField(book, pages.schema[book].dataType), T.StructField("block", T.LongType()), T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType())])

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, block, last, text, opened, waiting = state.get if state.exists else (first, 0, None, "", False, [])
        held = {w["page"]: w["text"] for w in waiting}
        for pdf in parts:
            for page, words in zip(pdf["page"].tolist(), pdf["text"], strict=True):
                if page < first:
                    continue
                if page < at or page in held:
                    raise ValueError(f"page {page} of {key[0]} came after its turn")
                held[int(page)] = words.strip(" ") if isinstance(words, str) else ""
        done = []
        for page in sorted(held):
            if page != at and not state.hasTimedOut:
                break
            text, last, opened, at = text + held.pop(page), page, True, page + 1
            if text.endswith(end) and text:
                done.append((key[0], block, last, text))
                block, text, opened = block + 1, "", False
        if state.hasTimedOut:
            if opened:
                done.append((key[0], block, last, text))
            state.remove()
        else:
            state.update((at, block, last, text, opened, [{"page": p, "text": t} for p, t in sorted(held.items())]))
            state.setTimeoutDuration(patience_ms)
        yield pd.DataFrame(done, columns=[book, "block", "page", "text"])

    return pages.groupBy(book).applyInPandasWithState(run, out, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
