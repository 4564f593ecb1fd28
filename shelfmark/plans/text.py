"""Text and entity queries: keys, similarities, matching, cleaning; titles are part names, texts documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import rules, titles
from shelfmark.functions import text as fn
from shelfmark.operators import ranking
from shelfmark.plans.registry import Tables, query, sql

# what a title is in DuckDB's own words: its fold of accents, then the classes of characters
_FOLD = "regexp_replace(nfc_normalize(strip_accents(lower({}))), '[\\x{{0300}}-\\x{{036F}}]', '', 'g')"
_KEY = f"trim(regexp_replace(regexp_replace({_FOLD}, '[\\p{{{{P}}}}\\p{{{{S}}}}]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_NOISE = ", ".join(f"'{w}'" for w in titles.NOISE)
_STOP = ", ".join(f"'{w}'" for w in titles.STOP)
_NORM = f"array_to_string(list_filter(string_split_regex(regexp_replace(regexp_replace({_FOLD}, '[''’`´\"״]', '', 'g'), '[^\\p{{{{L}}}}\\p{{{{N}}}}\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '' AND w NOT IN ({_NOISE})), ' ')"
# pairs of works and incoming titles: a part's name and its successor's
_PAIRS = "SELECT a.p_partkey AS id, lower(a.p_name) AS a, lower(b.p_name) AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"


def _pairs(t: Tables) -> DataFrame:
    b = t.part.select((F.col("p_partkey") - 1).alias("id"), F.lower("p_name").alias("b"))
    return t.part.select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("a")).join(b, "id")


# titles of four scripts: the first words of documents, and a name for each of some keys
_TITLES = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '進撃の巨人 Official' WHEN 1 THEN 'Ёж и Café (Scan PT-BR)' WHEN 2 THEN '나 혼자만 레벨업' ELSE substr(text, 1, 60) || ' Manhwa' END AS title FROM documents"


def _titles(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 5
    other = F.concat(F.substring("text", 1, 60), F.lit(" Manhwa"))
    return t.documents.select("doc_id", F.when(k == 0, "進撃の巨人 Official").when(k == 1, "Ёж и Café (Scan PT-BR)").when(k == 2, "나 혼자만 레벨업").otherwise(other).alias("title"))


@query(f"SELECT doc_id, coalesce({_NORM.format('title')}, '') AS title FROM ({_TITLES})")
def normalize_title(t: Tables) -> DataFrame:
    return _titles(t).select("doc_id", titles.normalize_title(F.col("title")).alias("title"))


@query(f"SELECT doc_id, {_KEY.format('title')} AS key FROM ({_TITLES})")
def catalog_title_key(t: Tables) -> DataFrame:
    return _titles(t).select("doc_id", titles.catalog_key(F.col("title")).alias("key"))


@query(f"SELECT doc_id, CASE WHEN len(w) >= 2 THEN array_to_string(w, ' ') END AS key FROM (SELECT doc_id, list_sort(list_filter(string_split_regex(regexp_replace({_FOLD.format('title')}, '[^a-z0-9\\x{{3040}}-\\x{{30FF}}\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{AC00}}-\\x{{D7AF}}\\s]', ' ', 'g'), '\\s+'), lambda x: x NOT IN ({_STOP}) AND x <> '')) AS w FROM ({_TITLES}))")
def sig_token_key(t: Tables) -> DataFrame:
    return _titles(t).select("doc_id", titles.significant_key(F.col("title")).alias("key"))


@query(f"SELECT page_id, trim(regexp_replace({_FOLD.format('url')}, '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages")
def slugify(t: Tables) -> DataFrame:
    return t.pages.select("page_id", titles.slugify(F.col("url")).alias("slug"))


@query(f"SELECT id, round(CASE WHEN greatest(len(a), len(b)) = 0 THEN 1 ELSE (greatest(len(a), len(b)) - levenshtein(a, b)) / greatest(len(a), len(b)) END, 9) AS ratio FROM ({_PAIRS})")
def lev_ratio(t: Tables) -> DataFrame:
    return _pairs(t).select("id", F.round(titles.levenshtein_ratio(F.col("a"), F.col("b")), 9).alias("ratio"))


@query(f"SELECT id, round(len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))), 9) AS jaccard FROM ({_PAIRS})")
def token_jaccard(t: Tables) -> DataFrame:
    return _pairs(t).select("id", F.round(titles.token_overlap(F.col("a"), F.col("b")), 9).alias("jaccard"))


_GRAMS = "list_distinct(list_transform(range(1, len('  ' || {0} || '  ') - 1), lambda i: substr('  ' || {0} || '  ', i, 3)))"


@query(f"SELECT id, round(2.0 * len(list_intersect(x, y)) / (len(x) + len(y)), 9) AS dice FROM (SELECT id, {_GRAMS.format('a')} AS x, {_GRAMS.format('b')} AS y FROM ({_PAIRS}))")
def trigram_dice(t: Tables) -> DataFrame:
    return _pairs(t).select("id", F.round(fn.trigram_dice(F.col("a"), F.col("b")), 9).alias("dice"))


_BIGRAMS = "SELECT id, g, count(*) AS n FROM (SELECT id, unnest(list_transform(range(1, len({0})), lambda i: substr({0}, i, 2))) AS g FROM p) GROUP BY ALL"
_DICE = f"""WITH p AS ({_PAIRS}), x AS ({_BIGRAMS.format('a')}), y AS ({_BIGRAMS.format('b')}), s AS (SELECT x.id, sum(least(x.n, y.n)) AS n FROM x JOIN y ON x.id = y.id AND x.g = y.g GROUP BY x.id),
d AS (SELECT p.*, CASE WHEN a = b THEN 1e0 WHEN least(len(a), len(b)) < 2 THEN 0e0 ELSE 2e0 * coalesce(n, 0) / (len(a) + len(b) - 2) END AS dice FROM p LEFT JOIN s ON s.id = p.id)"""


@query(f"{_DICE} SELECT id, round(dice, 9) AS dice FROM d")
def dice_bigram(t: Tables) -> DataFrame:
    return _pairs(t).select("id", F.round(titles.dice_bigram(F.col("a"), F.col("b")), 9).alias("dice"))


@query(f"{_DICE} SELECT id, round(0.45e0 * dice + 0.35e0 * (greatest(len(a), len(b)) - levenshtein(a, b)) / greatest(len(a), len(b)) + 0.2e0 * len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))), 9) AS score FROM d")
def fuzzy_score(t: Tables) -> DataFrame:
    return _pairs(t).select("id", F.round(titles.fuzzy_raw(F.col("a"), F.col("b")), 9).alias("score"))


# pairs with the answer that the rules ask for: title, candidate, other names of each, slugs, kind; method, confidence
_MATCHES = [
    ("SandLand", "Sand Land", [], [], None, None, None, "EXACT_TITLE", 0.98), ("Céu Distante - Manhwa PT-BR", "ceu distante!", [], [], None, None, None, "EXACT_TITLE", 1.0), ("The Witches of Eden", "Eden of Witches", [], [], None, None, None, "EXACT_TITLE", 0.96),
    ("O Mestre da Espada Genial da Academia", "Academy's Genius Swordmaster", ["Academy’s Genius Swordmaster"], [], None, None, None, "ALIAS_EXACT", 0.95), ("Solo Leveling (Novel)", "Solo Leveling", [], [], None, None, None, "NO_MATCH", 0.0), ("Solo Leveling", "Solo Leveling", [], [], None, None, "NOVEL", "NO_MATCH", 0.0),
    ("Tower of God Season 2", "Tower of God Season 1", [], [], None, None, None, "NO_MATCH", 0.0), ("Tower of God Season 1", "Tower of God", [], [], None, None, None, "NO_MATCH", 0.0), ("Eleceed", "Eleceed Side Story", [], [], None, None, None, "NO_MATCH", 0.0), ("Bocchi the Rock Hentai", "Bocchi the Rock!", [], [], None, None, None, "NO_MATCH", 0.0),
    ("Pack de Fotos X", "Fotos X", [], [], None, None, None, "NO_MATCH", 0.0), ("Series Title – 1", "Series Title", [], [], None, None, None, "NO_MATCH", 0.0), ("Series Title ~ Animação", "Series Title", [], [], None, None, None, "NO_MATCH", 0.0), ("Series Title Live Action", "Series Title", [], [], None, None, None, "NO_MATCH", 0.0),
    ("Dragon Ball", "Dragon Ball Super", [], [], None, None, None, "NO_MATCH", 0.0), ("Imperador Mágico", "Magic Emperor", [], [], None, None, None, "ALIAS_EXACT", 0.96), ("Solo Leveling", "Any", [], ["Only I Level Up"], None, None, None, "ALIAS_EXACT", 0.96), ("One Title", "Other Words", [], [], "x-y", "X Y", None, "EXACT_SLUG", 1.0),
    ("Return of the Mage", "Return of the Mage: Origin Tale", ["Origin Tale"], [], None, None, None, "ALIAS_EXACT", 0.96), ("Return of the Mage Origin Tale", "Return of the Mage", [], ["The Origin Tale"], None, None, None, "ALIAS_EXACT", 0.96), ("Alpha Beta", "Gamma Delta", ["The Hidden Kingdom"], ["the hidden kingdom"], None, None, None, "ALIAS_EXACT", 0.95),
    ("Alpha Beta", "Sorry", ["Sorry"], [], None, None, None, "NO_MATCH", 0.0), ("Gamma", "Long Other Name", [], ["Gamma"], None, None, None, "NO_MATCH", 0.0), ("Gamma Ray", "Long Other Name", [], ["Gamma Ray!"], None, None, None, "ALIAS_EXACT", 0.95), ("Gamma", "Long Other Name", ["Delta"], ["Delta"], None, None, None, "NO_MATCH", 0.0),
    ("the great hero returns", "The Great Hero Return", [], [], None, None, None, "FUZZY_HIGH", 0.8931), ("King of the Dark Moon", "King of the Dark Moon Rising", [], [], None, None, None, "FUZZY_HIGH", 0.88), ("Summer Break!", "Natsuyasumi! | Summer Break!", [], [], None, None, None, "EXACT_TITLE", 1.0),
    ("Summer Break", "Pack (Winter / Summer Break)", [], [], None, None, None, "NO_MATCH", 0.0), ("犬夜叉", "犬夜叉", [], [], None, None, None, "EXACT_TITLE", 1.0), ("進撃の巨人", "進撃の小人", [], [], None, None, None, "NO_MATCH", 0.0), ("", None, [], [], None, None, None, "NO_MATCH", 0.0),
]


@query(f"SELECT p_partkey, method, confidence::DOUBLE AS confidence FROM part JOIN (VALUES {', '.join(f'({i}, {m[-2]!r}, {m[-1]})' for i, m in enumerate(_MATCHES))}) v(i, method, confidence) ON p_partkey % {len(_MATCHES)} = i")
def match_cascade(t: Tables) -> DataFrame:
    text = lambda v: F.lit(v).cast("string")
    rows = F.array(*(F.struct(text(a).alias("a"), text(b).alias("b"), F.array(*map(F.lit, x)).cast("array<string>").alias("x"), F.array(*map(F.lit, y)).cast("array<string>").alias("y"), text(sa).alias("sa"), text(sb).alias("sb"), text(k).alias("ka")) for a, b, x, y, sa, sb, k, _, _ in _MATCHES))
    pairs = t.part.select("p_partkey", F.get(rows, (F.col("p_partkey") % len(_MATCHES)).cast("int")).alias("c")).select("p_partkey", "c.*")
    return titles.match_titles(pairs, "p_partkey", "a", "b", "x", "y", "sa", "sb", "ka")


@query("SELECT p_partkey, p_name || ' II' AS aliases FROM part")
def alias_merge(t: Tables) -> DataFrame:
    names = F.array(F.upper("p_name"), F.replace("p_name", F.lit(" "), F.lit("-")), F.concat("p_name", F.lit(" II")), F.lit(""), F.concat("p_name", F.lit("  II")))
    return t.part.select("p_partkey", F.array_join(fn.merge_aliases("p_name", names), "|").alias("aliases"))


@query("""
WITH w AS (SELECT p_partkey AS work, lower(p_name) || p_brand || p_type AS k FROM part WHERE p_partkey % 2 = 0), i AS (SELECT p_partkey AS item, lower(p_name) || p_brand || p_type AS k FROM part WHERE p_partkey % 2 = 1),
own AS (SELECT k, min(work) AS work FROM w GROUP BY k HAVING count(DISTINCT work) = 1)
SELECT item, min(work) AS work FROM i JOIN own USING (k) GROUP BY item HAVING count(DISTINCT work) = 1""")
def catalog_exact_match(t: Tables) -> DataFrame:
    """Keys that one work owns; items that meet one work. Conflicts match nothing."""
    key = F.concat(F.lower("p_name"), "p_brand", "p_type").alias("k")
    w, i = t.part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("work"), key), t.part.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("item"), key)
    own = w.distinct().groupBy("k").agg(F.min("work").alias("work"), F.count("*").alias("n")).where("n = 1").drop("n")
    return i.join(own, "k").select("item", "work").distinct().groupBy("item").agg(F.min("work").alias("work"), F.count("*").alias("n")).where("n = 1").drop("n")


_FUZZY = f"""
WITH w AS (SELECT DISTINCT lower(p_name) AS b FROM part WHERE p_partkey % 2 = 0), i AS (SELECT DISTINCT lower(p_name) AS a FROM part WHERE p_partkey % 2 = 1),
x AS (SELECT a, len(g) AS na, unnest(g) AS g FROM (SELECT a, {_GRAMS.format('a')} AS g FROM i)), y AS (SELECT b, len(g) AS nb, unnest(g) AS g FROM (SELECT b, {_GRAMS.format('b')} AS g FROM w)),
s AS (SELECT a, b, 2.0::DOUBLE * count(*) / (na + nb) AS score FROM x JOIN y USING (g) GROUP BY a, b, na, nb),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS n, lead(score) OVER (PARTITION BY a ORDER BY score DESC, b) AS second FROM s)
SELECT a, b, round(score, 9) AS score FROM r WHERE n = 1 AND score >= 0.86 AND score - coalesce(second, 0) >= 0.04
"""


@query(_FUZZY)
def trigram_fuzzy_match(t: Tables) -> DataFrame:
    """All items (odd keys) against all works (even ones). Blocking by shared trigrams: a pair's are counted in a join
    of grams; of an item's scores only the best two are kept, which its rank limits before the shuffle's sort."""
    grams = lambda d: d.withColumn("g", F.explode(fn.grams(F.col("k"), 3, "  "))).withColumn("n", F.size(fn.grams(F.col("k"), 3, "  ")))
    w = grams(t.part.where("p_partkey % 2 = 0").select(F.lower("p_name").alias("k")).distinct()).select(F.col("k").alias("b"), "g", F.col("n").alias("nb"))
    i = grams(t.part.where("p_partkey % 2 = 1").select(F.lower("p_name").alias("k")).distinct()).select(F.col("k").alias("a"), "g", F.col("n").alias("na"))
    s = i.join(w, "g").groupBy("a", "b", "na", "nb").count().withColumn("score", 2.0 * F.col("count") / (F.col("na") + F.col("nb")))
    second = F.lit(-1) * F.col("score")
    two = s.groupBy("a").agg(F.min(F.struct(second.alias("s"), "b")).alias("best"), F.count("*").alias("n"), F.max("score").alias("score"))
    rest = s.join(two.select("a", F.col("best.b").alias("b")), ["a", "b"], "left_anti").groupBy("a").agg(F.max("score").alias("second"))
    found = two.where("score >= 0.86").join(rest, "a", "left").where(F.col("score") - F.coalesce("second", F.lit(0.0)) >= 0.04)
    return found.select("a", F.col("best.b").alias("b"), F.round("score", 9).alias("score"))


@query("SELECT lower(p_name) AS title, count(*) AS works, array_to_string(list_sort(list(p_partkey)), ',') AS members, CASE WHEN count(DISTINCT p_brand) = 1 THEN 'HIGH' ELSE 'LOW' END AS confidence FROM part GROUP BY lower(p_name) HAVING count(*) > 1")
def duplicate_groups(t: Tables) -> DataFrame:
    g = t.part.groupBy(F.lower("p_name").alias("title")).agg(F.count("*").alias("works"), F.array_sort(F.collect_set("p_partkey")).alias("m"), F.count_distinct("p_brand").alias("brands")).where("works > 1")
    return g.select("title", "works", F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("members"), F.when(F.col("brands") == 1, "HIGH").otherwise("LOW").alias("confidence"))


_SYNOPSIS = "list_filter(string_split_regex(regexp_replace(lower({0}.p_name || ' ' || {0}.p_type || ' ' || {0}.p_name || ' ' || {0}.p_brand), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda w: len(w) >= 4)"


@query(f"""{_DICE}, e AS (SELECT a.p_partkey AS id, a.p_brand = b.p_brand AS author, a.p_type = b.p_type AS kind, abs(a.p_size - b.p_size) <= 1 AS near, {_SYNOPSIS.format('a')} AS x, {_SYNOPSIS.format('b')} AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
f AS (SELECT d.id, author, kind, near, greatest(dice, (greatest(len(a), len(b)) - levenshtein(a, b)) / greatest(len(a), len(b)), len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' '))))) AS title,
  CASE WHEN least(len(array_to_string(x, ' ')), len(array_to_string(y, ' '))) < 30 THEN 0e0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END AS syn FROM d JOIN e ON d.id = e.id)
SELECT id, round(CASE WHEN author THEN 0.3e0 ELSE 0e0 END + CASE WHEN kind THEN 0.1e0 ELSE 0e0 END + CASE WHEN near THEN 0.05e0 ELSE 0e0 END + 0.25e0 * title + 0.3e0 * syn, 4) AS score,
  author AND kind AND syn >= 0.72 AND title >= 0.55 AS automatic, author AND kind AND NOT (syn >= 0.72 AND title >= 0.55) AND ((syn >= 0.35 AND title >= 0.3) OR title >= 0.72) AS ambiguous FROM f""")
def metadata_evidence(t: Tables) -> DataFrame:
    """What creators, kind, year, titles and synopses say about two works being one: a score, and whether it binds or is left to people."""
    fields = {"title": "p_name", "author": "p_brand", "artist": "p_container", "kind": "p_type", "year": "p_size", "synopsis": "synopsis"}
    synopsis = F.concat_ws(" ", "p_name", "p_type", "p_name", "p_brand").alias("synopsis")
    part = t.part.withColumn("p_container", F.lit(None).cast("string")).select("p_partkey", "p_name", "p_brand", "p_container", "p_type", "p_size", synopsis)
    a, b = (part.select((F.col("p_partkey") - shift).alias("id"), *(F.col(v).alias(f"{side}_{k}") for k, v in fields.items())) for side, shift in (("a", 0), ("b", 1)))
    return titles.metadata_evidence(a.join(b, "id"), "id")


sql("resolve_decision", """
WITH c AS (SELECT l_partkey AS item, l_suppkey AS work, max(l_discount * 10) AS score, bool_and(l_returnflag = 'N') AS fuzzy, bool_or(l_linestatus = 'F') AS evidence FROM lineitem GROUP BY l_partkey, l_suppkey),
r AS (SELECT *, CASE WHEN fuzzy AND NOT evidence THEN NULL ELSE score END AS binding FROM c),
t AS (SELECT item, work, binding, row_number() OVER (PARTITION BY item ORDER BY binding DESC NULLS LAST, work) AS n, lead(binding) OVER (PARTITION BY item ORDER BY binding DESC NULLS LAST, work) AS second, max(CASE WHEN binding IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY item) AS held FROM r)
SELECT item, CASE WHEN binding >= 0.85 THEN work END AS work, CASE WHEN coalesce(binding, 0) < 0.85 THEN CASE WHEN held = 1 OR binding >= 0.6 THEN 'AMBIGUOUS' ELSE 'NEW' END WHEN second >= 0.8 AND second >= binding - 0.1 THEN 'AMBIGUOUS' ELSE 'BOUND' END AS decision FROM t WHERE n = 1""")
sql("chapter_sort_key", "SELECT l_orderkey, l_linenumber, round(CAST(CASE WHEN l_returnflag = 'R' THEN l_linenumber + 0.0001 ELSE l_linenumber + l_discount END AS DECIMAL(10, 4)), 4) AS sort_key FROM lineitem")


@query("SELECT page_id, TRY_CAST(regexp_extract(url, '/([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE) AS number FROM pages")
def extract_number(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_extract("url", r"/([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double").alias("number"))


_STRIP = "regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _e, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _STRIP = f"replace({_STRIP}, '{_e}', '{_c}')"


@query(f"SELECT page_id, trim(regexp_replace({_STRIP}, '\\s+', ' ', 'g')) AS body FROM pages")
def html_strip(t: Tables) -> DataFrame:
    return t.pages.select("page_id", fn.strip_html(F.col("html")).alias("body"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, regexp_extract(html, '(?is)<html[^>]*lang=\"([a-z]+)\"', 1) AS lang, len(regexp_extract_all(html, '(?i)<a\\s')) AS links FROM pages")
def html_title(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.regexp_extract("html", '(?is)<html[^>]*lang="([a-z]+)"', 1).alias("lang"), F.regexp_count("html", F.lit(r"(?i)<a\s")).cast("long").alias("links"))


@query("SELECT page_id, list_extract(string_split(regexp_extract(html, '(?is)<nav>(.*?)</nav>', 1), '</li>'), 1) AS first_item, array_to_string(regexp_extract_all(html, '(?i)<h1>([^<]*)</h1>', 1), '|') AS headings FROM pages")
def html_extract_headings(t: Tables) -> DataFrame:
    nav = F.split(F.regexp_extract("html", "(?is)<nav>(.*?)</nav>", 1), "</li>")
    return t.pages.select("page_id", nav[0].alias("first_item"), F.array_join(F.regexp_extract_all("html", F.lit("(?i)<h1>([^<]*)</h1>"), F.lit(1)), "|").alias("headings"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x{3040}-\\x{30FF}]') THEN 'JAPANESE' WHEN regexp_matches(text, '[\\x{AC00}-\\x{D7AF}]') THEN 'KOREAN' WHEN regexp_matches(text, '[\\x{4E00}-\\x{9FFF}]') THEN 'CHINESE' WHEN regexp_matches(text, '[\\x{0400}-\\x{04FF}]') THEN 'CYRILLIC' WHEN regexp_matches(text, '[A-Za-z]') THEN 'LATIN' ELSE 'NONE' END AS script FROM documents")
def script_class(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fn.script(F.col("text")).alias("script"))


@query("SELECT doc_id, CASE WHEN len(s) >= 12 AND NOT regexp_matches(s, '(?i)captcha|just a moment') THEN substr(s, 1, 20000) END AS synopsis FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS s FROM documents)")
def synopsis_clean(t: Tables) -> DataFrame:
    s = F.trim(F.regexp_replace(F.regexp_replace("text", "<[^>]*>", " "), r"\s+", " "))
    return t.documents.select("doc_id", s.alias("s")).select("doc_id", F.when((F.length("s") >= 12) & ~F.col("s").rlike("(?i)captcha|just a moment"), F.substring("s", 1, 20000)).alias("synopsis"))


@query("""
WITH x AS (SELECT a.doc_id, a.source AS old, a.doc_id % 4 = 0 AS guarded, a.doc_id % 3 = 0 AS checked, (a.doc_id % 7)::INTEGER AS rank, b.lang AS new, (b.doc_id % 5)::INTEGER AS nrank, a.text AS old_text, b.text AS new_text
  FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, CASE WHEN trim(coalesce(new, '')) = '' OR guarded OR (checked AND nrank >= rank) THEN old ELSE trim(new) END AS value,
  CASE WHEN guarded OR len(trim(coalesce(new_text, ''))) < 12 OR (checked AND len(trim(new_text)) < len(old_text)) THEN old_text ELSE trim(new_text) END AS synopsis,
  array_to_string(list_distinct_ordered, '|') AS tags FROM (SELECT *, CASE WHEN old = new THEN [old] ELSE list_filter([old, new], lambda v: v IS NOT NULL) END AS list_distinct_ordered FROM x)""")
def metadata_merge(t: Tables) -> DataFrame:
    """A stored record and an incoming one by field: protected ones stay, validated ones give way to better ranks, longer synopses win, tags are united."""
    d = t.documents
    new = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("lang").alias("new"), (F.col("doc_id") % 5).cast("int").alias("nrank"), F.trim("text").alias("new_text"))
    k = F.col("doc_id")
    field = F.struct(F.col("source").alias("value"), (k % 4 == 0).alias("protected"), (k % 3 == 0).alias("validated"), (k % 7).cast("int").alias("rank"))
    x = d.select("doc_id", F.col("source").alias("old"), F.col("text").alias("old_text"), field.alias("f")).join(new, "doc_id")
    keeps = F.col("f.protected") | (F.length(F.coalesce("new_text", F.lit(""))) < 12) | (F.col("f.validated") & (F.length("new_text") < F.length("old_text")))
    tags = F.array_distinct(F.filter(F.array("old", "new"), lambda v: v.isNotNull()))
    return x.select("doc_id", rules.merged_field(F.col("f"), F.col("new"), F.col("nrank"))["value"].alias("value"), F.when(keeps, F.col("old_text")).otherwise(F.col("new_text")).alias("synopsis"), F.array_join(tags, "|").alias("tags"))


_ACCENTS = ("àáâãäåèéêëìíîïòóôõöùúûüçñ", "aaaaaaeeeeiiiiooooouuuucn")


@query("SELECT c_custkey, trim(translate(lower(c_name || ' ' || c_mktsegment), 'àáâãäåèéêëìíîïòóôõöùúûüçñ', 'aaaaaaeeeeiiiiooooouuuucn')) AS search_text FROM customer")
def accent_fold_search_text(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.trim(F.translate(F.lower(F.concat_ws(" ", "c_name", "c_mktsegment")), *_ACCENTS)).alias("search_text"))


@query("SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_hash_dedup(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


sql("health_ladder", "SELECT user_id, CASE WHEN e > 0.5 THEN 'CRITICAL' WHEN e > 0.22 THEN 'DEGRADED' WHEN n < 5 THEN 'UNKNOWN' ELSE 'HEALTHY' END AS verdict FROM (SELECT user_id, count(*) AS n, count(CASE WHEN event_type = 'error' THEN 1 END) / count(*) AS e FROM events GROUP BY user_id) x")


@query("""
WITH x AS (SELECT p_partkey, [p_name, upper(p_name), regexp_replace(p_name, '\\s+\\S+$', ''), string_split(p_name, ' ')[1], p_name || ' ' || p_brand, p_name || ' ' || p_type] AS t FROM part)
SELECT p_partkey, array_to_string(list_filter(t, lambda v, i: list_position(list_transform(t, lambda u: lower(u)), lower(v)) = i)[1:5], '|') AS queries FROM x""")
def query_candidates(t: Tables) -> DataFrame:
    """At most five search texts of a work, without repeats in other case."""
    name = F.col("p_name")
    texts = F.array(name, F.upper(name), F.regexp_replace(name, r"\s+\S+$", ""), F.split(name, " ")[0], F.concat_ws(" ", name, "p_brand"), F.concat_ws(" ", name, "p_type"))
    folded = F.transform(texts, F.lower)
    first = F.filter(texts, lambda x, i: F.array_position(folded, F.lower(x)) == i + 1)
    return t.part.select("p_partkey", F.array_join(F.slice(first, 1, 5), "|").alias("queries"))


@query("SELECT doc_id, sha256(text) AS digest, first_value(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS media, first_value(doc_id) OVER (PARTITION BY text ORDER BY doc_id) <> doc_id AS reused FROM documents")
def hash_reuse(t: Tables) -> DataFrame:
    """The oldest medium of the same digest is used again; groups meet pre-aggregated, not in a window."""
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))
    oldest = ranking.distinct_on(d, ["digest"], ["doc_id"]).select("digest", F.col("doc_id").alias("media"))
    return d.join(oldest, "digest").select("doc_id", "digest", "media", (F.col("media") != F.col("doc_id")).alias("reused"))
