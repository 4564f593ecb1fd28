"""Catalogue sources over stored pages: one parser table for families of sites, a paged reader, named procedures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import strip_html
from shelfmark.functions.titles import slugify

#: Rows of a page of a listing; a shorter page is the last.
PAGE = 10


@dataclass(frozen=True)
class Family:
    """Where a family of sites keeps its fields: regexes with one group over a page's HTML."""

    name: str
    title: str = r"(?is)<h1[^>]*>(.*?)(?:</h1>|<p)"
    cover: str = r"(?is)<img[^>]*src=\"([^\"]*)\""
    link: str = r"(?is)<a[^>]*href=\"([^\"]*)\""


FAMILIES = {f.name: f for f in (Family("article"), Family("titled", title=r"(?is)<title[^>]*>(.*?)</title>"))}


def works(pages: DataFrame, family: str = "article") -> DataFrame:
    """page_id, source, slug, title, cover, links of stored pages, by a family's parser; no network."""
    f = FAMILIES[family]
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    title = strip_html(F.regexp_extract("html", f.title, 1))
    return pages.select("page_id", host.alias("source"), slugify(title).alias("slug"), title.alias("title"), F.nullif(F.regexp_extract("html", f.cover, 1), F.lit("")).alias("cover"), F.regexp_extract_all("html", F.lit(f.link), F.lit(1)).alias("links"))


def page_after(df: DataFrame, key: str, cursor=None, size: int = PAGE) -> tuple[DataFrame, object]:
    """The next page of a listing by key, and the cursor for the one after it, None at the end."""
    rows = (df if cursor is None else df.where(F.col(key) > F.lit(cursor))).orderBy(key).limit(size)
    keys = [r[0] for r in rows.select(key).collect()]  # a page
    return rows, keys[-1] if len(keys) == size else None


class Procedures:
    """Named query functions, called with arguments by name."""

    def __init__(self):
        self._known: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str, f: Callable[..., DataFrame]) -> None:
        self._known[name] = f

    def call(self, name: str, **arguments) -> DataFrame:
        if name not in self._known:
            raise KeyError(f"no procedure {name}")
        return self._known[name](**arguments)


def settings_map(df: DataFrame, key: str = "key", value: str = "value", most: int = 10_000) -> dict:
    """A small settings table as a dict; ValueError if it has more rows than settings may have."""
    rows = df.select(key, value).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for settings")
    return {r[0]: r[1] for r in rows}
