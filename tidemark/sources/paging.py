"""Reading a paged history service: retries, time cursors, bad pages; as a generator and a data source.

The fetch function is injected (``fetch(path, params) -> list of dicts``), so the logic is the same for a
network client and for pages kept in files, which is what the data source ``history_pages`` reads.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from itertools import islice

from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetch = Callable[[str, dict], list]
DAY = 86_400


class BadPage(Exception):
    """A page the service cannot give; the cursor skips a day."""


class Busy(Exception):
    """The service asks to wait ``seconds``."""

    def __init__(self, seconds: float = 1.0):
        super().__init__(f"wait {seconds} s")
        self.seconds = seconds


def get(fetch: Fetch, path: str, params: dict, tries: int = 5, most_wait: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> list:
    """One page, waiting as told when the service is busy and doubling on other faults."""
    for attempt in range(tries):
        try:
            return fetch(path, params)
        except Busy as e:
            sleep(min(e.seconds, most_wait))
        except (ConnectionError, TimeoutError):
            sleep(min(2.0**attempt, most_wait))
    raise ConnectionError(f"{path}: no answer after {tries} tries")


def pages(fetch: Fetch, path: str, params: dict, newest_first: bool = False, page_size: int = 100, most_skips: int = 400, **how) -> Iterator[dict]:
    """Rows of all pages by time cursor, each id once; a bad page moves the cursor by a day.

    Forward from ``params["after"]``, or backward from ``params["before"]`` when newest first; both ends belong
    to the page. The next page begins at the last second of this one, whose ids are remembered, so rows
    that share a second are not lost; if a whole page is one second, larger pages are asked for. More
    than ``most_skips`` bad pages in a row, or one without a cursor to move, are an error.
    """
    cursor, edge, step = dict(params), "before" if newest_first else "after", -DAY if newest_first else DAY
    seen: set = set()
    skips, size = 0, page_size
    while True:
        try:
            batch = get(fetch, path, {**cursor, "limit": size, "sort": "desc" if newest_first else "asc"}, **how)
        except BadPage as e:
            skips += 1
            if skips > most_skips or edge not in cursor:
                raise ConnectionError(f"{path}: {skips} bad pages in a row") from e
            cursor[edge] += step
            continue
        skips = 0
        fresh = [r for r in batch if r["id"] not in seen]
        yield from fresh
        if len(batch) < size:
            return
        times = [r["created_utc"] for r in batch]
        last = min(times) if newest_first else max(times)
        size = page_size if fresh else size * 2
        seen = {r["id"] for r in batch if r["created_utc"] == last} | (seen if last == cursor.get(edge) else set())
        cursor[edge] = last


#: The columns of an item, as every source gives them.
ITEM = ("item_id", "kind", "subreddit", "created_utc", "body", "score", "parent_id", "link_id", "permalink", "source")


def comment_item(raw: dict, source: str) -> dict:
    """P1 for a row of a service: a comment as an item; a link is made from its thread where none is given."""
    thread = (raw.get("link_id") or "").partition("_")[2]
    link = raw.get("permalink") or (f"/comments/{thread}/_/{raw['id']}/" if thread else "")
    values = (f"t1_{raw['id']}", "comment", str(raw.get("subreddit") or "").lower(), raw.get("created_utc"), raw.get("body") or "", raw.get("score") or 0, raw.get("parent_id") or "", raw.get("link_id") or "", link, source)
    return dict(zip(ITEM, values))


def post_item(raw: dict, source: str) -> dict:
    """P2 for a row of a service: a post as an item, title and text joined by an empty line."""
    parts = [t for t in ((raw.get("title") or "").strip(), (raw.get("selftext") or "").strip()) if t]
    link = raw.get("permalink") or f"/comments/{raw['id']}/"
    values = (f"t3_{raw['id']}", "post", str(raw.get("subreddit") or "").lower(), raw.get("created_utc"), "\n\n".join(parts), raw.get("score") or 0, "", f"t3_{raw['id']}", link, source)
    return dict(zip(ITEM, values))


def history(fetch: Fetch, author: str, after: int = 0, posts: bool = True, most: int | None = None, source: str = "archive", **how) -> list[dict]:
    """S3: the items of an author, oldest first, each once; ``most`` of each kind, then the newest ones."""
    kinds = [("comments", comment_item)] + ([("posts", post_item)] if posts else [])
    found: dict[str, dict] = {}
    for path, item in kinds:
        params = {"author": author, ("before" if most is not None else "after"): (1 << 40 if most is not None else after)}
        rows = (r for r in pages(fetch, path, params, newest_first=most is not None, **how) if r["created_utc"] >= after)
        for raw in islice(rows, most):
            found.setdefault(f"{path}{raw['id']}", item(raw, source))
    return sorted(found.values(), key=lambda r: (r["created_utc"], r["item_id"]))


def recent(listing: Callable[[str, int], tuple[list, list]], author: str, limit: int = 1000, source: str = "listing") -> list[dict]:
    """A second kind of source, which gives only the newest comments and posts: ``listing(author, limit)``."""
    comments, posts = listing(author, limit)
    rows = [comment_item(r, source) for r in comments[:limit]] + [post_item(r, source) for r in posts[:limit]]
    return sorted({r["item_id"]: r for r in rows}.values(), key=lambda r: (r["created_utc"], r["item_id"]))


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str, page_size: int):
        self.path, self.page_size = path, page_size

    def partitions(self):
        files, root = FileSystem.from_uri(self.path) if "://" in self.path else (FileSystem.from_uri("file://" + self.path)[0], self.path)
        found = sorted(f.path for f in files.get_file_info(FileSelector(root)) if f.path.endswith(".jsonl"))
        head = self.path.partition("://")[0] + "://" if "://" in self.path else "file://"
        return [_Part(head + p if not p.startswith(head) else p) for p in found] or [_Part("")]

    def read(self, partition):
        if not partition.path:
            return
        files, path = FileSystem.from_uri(partition.path)
        with files.open_input_file(path) as f:
            rows = [json.loads(line) for line in f.read().decode("utf-8").splitlines() if line.strip()]

        def fetch(_, params):
            kept = sorted((r for r in rows if r["created_utc"] >= params.get("after", 0)), key=lambda r: (r["created_utc"], r["id"]))
            return kept[: params["limit"]]

        for r in pages(fetch, partition.path, {"after": 0}, page_size=self.page_size):
            yield r["id"], r.get("account_hash"), r.get("kind"), r.get("subreddit"), r["created_utc"], r.get("body"), r.get("score")


class HistoryPages(DataSource):
    """``spark.read.format("history_pages").option("path", folder)``: one file of rows per account."""

    @classmethod
    def name(cls):
        return "history_pages"

    def schema(self):
        return "item_id string, account_hash string, kind string, subreddit string, created_utc bigint, body string, score int"

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("page_size", 100)))
