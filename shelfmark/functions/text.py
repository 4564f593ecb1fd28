"""Texts as Columns: grams, aliases, scripts, HTML; pandas only where Spark has no expression (NFKC)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

def grams(c: Column, n: int, pad: str = "") -> Column:
    """Distinct runs of n characters of a padded text, empty if it is shorter."""
    s = F.concat(F.lit(pad), c, F.lit(pad)) if pad else c
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - (n - 1), F.lit(1))), lambda i: F.substring(s, i, F.lit(n)))
    return F.array_distinct(F.filter(runs, lambda g: F.length(g) == n))


def trigram_dice(a: Column, b: Column) -> Column:
    """2 * common / (count + count) of distinct trigrams, both texts padded by two spaces on either side."""
    x, y = grams(a, 3, "  "), grams(b, 3, "  ")
    return 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))


@F.pandas_udf(T.ArrayType(T.StringType()))
def merge_aliases(primary: pd.Series, aliases: pd.Series) -> pd.Series:
    """Aliases without the primary title, empty ones and repeats in other spelling (the first stays); 50 at most."""

    def key(s):
        return re.sub(r"[\s\-_:.,!?'\"]+", "", unicodedata.normalize("NFKC", s).casefold())

    def one(title, names):
        seen, out = {key(title or "")}, []
        for n in names if names is not None else ():
            n = (n or "").strip()
            if n and key(n) and key(n) not in seen:
                seen.add(key(n))
                out.append(n)
        return out[:50]

    return pd.Series([one(*r) for r in zip(primary, aliases, strict=True)], dtype=object)


def script(text: Column) -> Column:
    """The script that a text is mostly written in, from the characters that only it has."""
    t = F.coalesce(text, F.lit(""))
    n = lambda p: F.regexp_count(t, F.lit(p))
    return (
        F.when(n("[\\x{3040}-\\x{30FF}]") > 0, "JAPANESE").when(n("[\\x{AC00}-\\x{D7AF}]") > 0, "KOREAN").when(n("[\\x{4E00}-\\x{9FFF}]") > 0, "CHINESE")
        .when(n("[\\x{0400}-\\x{04FF}]") > 0, "CYRILLIC").when(n("[A-Za-z]") > 0, "LATIN").otherwise("NONE")
    )


def strip_html(html: Column) -> Column:
    """Text of a page: no scripts, styles, comments and tags; the common entities; spaces run together."""
    t = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))
