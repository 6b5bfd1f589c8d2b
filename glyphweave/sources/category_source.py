"""Category listings as a Spark data source, in batch and as a stream.

    spark.dataSource.register(CategoryMembers)
    spark.readStream.format("category_members").options(categories='["Category:X"]', get="module:function", progress="file:///shared/listing").load()

A partition is a category: tasks follow its continuation tokens, page by page, and the driver sees neither titles nor tokens of a page that is being
read. The stream's offset counts the pages read of each category. The token that leads to a page is a small file that the task which
read the page before has written to the progress folder, so a stream that is stopped goes on where its checkpoint says, and a task
that runs twice asks for the same page. A micro-batch reads one page of each category that has more.

get(parameters) gives the site's answer as a dict, or (status, body), whose status is checked; it is imported where tasks run.
"""

from __future__ import annotations

import importlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import quote

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from glyphweave.sources.ingest import check_status

SCHEMA = "category string, page int, ord int, title string"


class Pages(InputPartition):
    """Pages first, first + 1, ... of a category, up to but without last; None: to the end."""

    def __init__(self, category: str, first: int = 0, last: int | None = None):
        self.category, self.first, self.last = category, first, last


def named(path: str) -> Callable[[dict], Any]:
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def answer(get: Callable[[dict], Any], category: str, token: str | None, limit: int, retries: int, wait: float) -> tuple[list[str], str | None]:
    """(titles, next token or None) of one page; it is tried `retries` times at most, then the task fails and Spark tries it elsewhere."""
    asked = {"action": "query", "list": "categorymembers", "cmtitle": category, "cmlimit": limit, "format": "json"} | ({"cmcontinue": token} if token else {})
    for turn in range(retries):
        try:
            data = get(asked)
            if isinstance(data, tuple):
                data = json.loads(check_status(*data))
            break
        except Exception:
            if turn == retries - 1:
                raise
            time.sleep(wait * 2**turn)
    titles = [m["title"] for m in data.get("query", {}).get("categorymembers", [])]
    return titles, data.get("continue", {}).get("cmcontinue")


class _Reader:
    def __init__(self, options: dict):
        self.get, self.categories = options["get"], json.loads(options["categories"])
        self.limit, self.retries, self.wait = int(options.get("limit", 500)), int(options.get("retries", 5)), float(options.get("wait", 5))
        self.progress = options.get("progress")
        if len(set(self.categories)) < len(self.categories):
            raise ValueError("a category is named twice")

    def read(self, part: Pages) -> Iterator[tuple[str, int, int, str]]:
        get, page = named(self.get), part.first
        token = self.token(part.category, page) if page else None
        while part.last is None or page < part.last:
            titles, token = answer(get, part.category, token, self.limit, self.retries, self.wait)
            page += 1
            if part.last is not None:
                self.note(part.category, page, token)
            # pages of categories are no lemmas; ord is the place on the page
            yield from ((part.category, page - 1, k, t) for k, t in enumerate(titles) if not t.startswith("Category:"))
            if token is None:
                return

    def _folder(self, category: str) -> tuple[Any, str]:
        from pyarrow.fs import FileSystem

        fs, path = FileSystem.from_uri(self.progress)
        return fs, f"{path}/{quote(category, safe='')}"

    def token(self, category: str, page: int) -> str | None:
        fs, folder = self._folder(category)
        with fs.open_input_stream(f"{folder}/{page}.json") as f:
            return json.loads(f.read())["token"]

    def note(self, category: str, page: int, token: str | None) -> None:
        """What leads to a page, written whole under another name first; None: there is no such page."""
        fs, folder = self._folder(category)
        fs.create_dir(folder, recursive=True)
        temporary = f"{folder}/.{page}-{uuid.uuid4().hex}"
        with fs.open_output_stream(temporary) as f:
            f.write(json.dumps({"token": token}).encode())
        fs.move(temporary, f"{folder}/{page}.json")

    def read_pages(self, category: str) -> int:
        """How many pages have been read, by the progress folder."""
        from pyarrow.fs import FileSelector

        fs, folder = self._folder(category)
        found = fs.get_file_info(FileSelector(folder, allow_not_found=True))
        return max((int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json") and not f.base_name.startswith(".")), default=0)


class BatchReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Pages]:
        return [Pages(c) for c in self.categories]


class StreamReader(_Reader, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        if not self.progress:
            raise ValueError("a stream needs the option progress, a folder that all executors share")

    def initialOffset(self) -> dict:
        return {c: 0 for c in self.categories}

    def latestOffset(self) -> dict:
        out = {}
        for c in self.categories:
            done = self.read_pages(c)
            out[c] = done if done and self.token(c, done) is None else done + 1
        return out

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return [Pages(c, start.get(c, 0), last) for c, last in end.items() if last > start.get(c, 0)]

    def commit(self, end: dict) -> None:
        """Tokens stay: they are what a restart from an older checkpoint needs."""


class CategoryMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "category_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)
