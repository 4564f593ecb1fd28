"""Titles as Columns: keys for every script, what sets works apart, and the cascade of rules by which two titles match.

Everything stays in the JVM. Letters lose their accents over a table that follows from Unicode's own decompositions.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that say how a title was published, not what it is.
NOISE = "manga manhwa manhua webtoon comic scan scans scanlator fansub pt-br ptbr pt br portugues portuguese online color raw oficial official".split()
# Words that carry no meaning of their own.
STOP = "the a an of in on at to for with by from and or o os as um uma de da do dos das em no na nos nas por com e ou".split()
# Titles of one work in several languages.
SYNONYMS = (
    ("imperador magico", "imperador demoniaco", "magic emperor", "demonic emperor", "the servant is the demon king", "the servant is the demon king?!", "mo huang da guan jia", "devil butler", "the devils butler"),
    ("mestre supremo de artes marciais", "supreme martial artist", "peerless martial god"),
    ("solo leveling", "only i level up", "na honjaman rebeleob"),
    ("o comeco depois do fim", "the beginning after the end", "tbate"),
    ("ponto de vista do leitor onisciente", "omniscient reader viewpoint", "orv", "leitor onisciente"),
    ("o retorno do heroi da classe desastre", "return of the disaster class hero", "return of the disaster-class hero", "retorno do heroi de nivel maximo"),
    ("o mercenario de ouro", "mercenary enrollment", "teenage mercenary"),
    ("grande mestre das artes marciais", "grandmaster of demonic cultivation", "mo dao zu shi"),
    ("troublesome sister 2", "troublesome sister 2: blazing sun", "troublesome sister season 2"),
)
# Words and phrases that name another part or edition of a work.
MARKERS = "super z gt kai daima shippuden shippuuden boruto vigilantes re darkness zero apocrypha omega brotherhood reboot byakuya remake sequel prequel 2 3 4 5 6 7 8 9 ii iii iv v vi vii viii".split()
PHRASES = ("next generations", "lost canvas", "next dimension", "new waves", "eternal force", "four knights", "team up missions", "live action")
# Patterns of titles that only match titles of their own kind.
NOVEL = r"(?i)\b(novel|light novel|webnovel|ln|wn|web novel|romance|livro)\b"
PACK = r"(?i)^(?:pack|pacote)\s+de\s+(?:imagens|fotos|cosplay|artes?)\b"
ADULT = r"(?i)\b(?:hentai|porno|pornô|doujin(?:shi)?)\b"
SPIN_OFF = r"(?i)\b(side story|gaiden|spin-off|spinoff|extra story|hist[oó]ria paralela|hist[oó]ria extra|vigilantes|team-up missions|team up missions|anthology|antologia|4-koma|4koma|yonkoma|reboot|one-shot|oneshot)\b"
SEASON = (r"(?:season|temporada|temp|part|parte|s)\s*(\d+|vii|vi|v|iv|iii|ii|i)\b", r"(\d+)[ªaºo]?\s*(?:temporada|season|parte|part)\b")
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7"}
PART_ONE = r"(?i)(?:[-–—:]|\b(?:part|parte|vol|volume|season|temporada))\s*(?:1|i)\b|\s+(?:1|i)$"
ADAPTED = r"(?i)(?:[-–—~:]|\b(?:vers[aã]o|formato))\s*(?:anima[cç][aã]o|animation|anime|live\s*action)\b|\[(?:anime|anima[cç][aã]o|live\s*action)\]"
GENERIC = r"(?i)^(?:sorry|desculpa|perdao|por\s*favor|please|onegai|obrigad[ao]|thanks?|thank\s*you|na\s*verdade|actually|in\s*fact|turns\s*out|love|hello|alone|baby|oneshot|manga|comic|primal|scan|raw)$"
GENERIC_SHARED = GENERIC[:-2] + "|action|drama|fantasy|romance)$"


def _fold() -> tuple[str, str]:
    """Characters that are one other character without the marks U+0300 to U+036F, and these."""
    pairs = {}
    for code in [*range(0xC0, 0x2000), *range(0xFF01, 0xFF5F)]:
        c = chr(code).lower()
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not "̀" <= x <= "ͯ")
        plain = unicodedata.normalize("NFC", plain)
        if len(c) == 1 and len(plain) == 1 and plain != c:
            pairs[c] = plain
    return "".join(pairs), "".join(pairs.values())


FOLD = _fold()


def folded(c: Column) -> Column:
    """Lower case without accents; marks that stand alone go too."""
    return F.regexp_replace(F.translate(F.lower(c), *FOLD), "[\\x{0300}-\\x{036F}]", "")


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def normalize_title(c: Column) -> Column:
    """Lower case, no accents and apostrophes, other signs one space, noise words out; letters of every script stay."""
    t = F.regexp_replace(folded(F.coalesce(c, F.lit(""))), "['’`´\"״]", "")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\s]", " ")
    return F.array_join(F.filter(_words(t), lambda w: ~w.isin(*NOISE)), " ")


def catalog_key(c: Column) -> Column:
    """Lower case, no accents, punctuation and symbols one space; letters of every script stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded(c), r"[\p{P}\p{S}]+", " "), r"\s+", " "))


def significant_key(c: Column) -> Column:
    """Sorted words that aren't stop words, Latin, kana, Han and Hangul only; null under two of them."""
    t = F.regexp_replace(folded(c), r"[^a-z0-9\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\s]", " ")
    words = F.array_sort(F.filter(_words(t), lambda w: ~w.isin(*STOP)))
    return F.when(F.size(words) >= 2, F.array_join(words, " "))


def slugify(c: Column) -> Column:
    """a-z and digits, everything else one hyphen."""
    return F.regexp_replace(F.regexp_replace(folded(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


# -- similarities
def bigrams(c: Column) -> Column:
    """Runs of two characters, each with how often it has come so far, so that sets of them are multisets."""
    n = F.greatest(F.length(c) - 1, F.lit(0))
    runs = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    # bound once: what a lambda names from outside is made again for each element
    return F.transform(F.array(F.array_sort(runs)), lambda r: F.transform(r, lambda g, i: F.concat(g, (i - F.array_position(r, g)).cast("string"))))[0]


def dice_bigram(a: Column, b: Column) -> Column:
    """Dice over multisets of bigrams: 1 for equal texts, 0 under two characters."""
    a, b = F.trim(a), F.trim(b)
    shared = F.size(F.array_intersect(bigrams(a), bigrams(b)))
    return F.when(a == b, 1.0).when((F.length(a) < 2) | (F.length(b) < 2), 0.0).otherwise(2.0 * shared / (F.length(a) + F.length(b) - 2))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """(longest - distance) / longest; 1 for equal texts."""
    a, b = F.trim(a), F.trim(b)
    most = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise((most - F.levenshtein(a, b)) / most)


def token_overlap(a: Column, b: Column) -> Column:
    """Common words over all words; 0 if either has none."""
    x, y = F.array_distinct(_words(a)), F.array_distinct(_words(b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def fuzzy_raw(a: Column, b: Column) -> Column:
    """0.45 Dice + 0.35 Levenshtein + 0.2 words in common; normalised titles."""
    return 0.45 * dice_bigram(a, b) + 0.35 * levenshtein_ratio(a, b) + 0.2 * token_overlap(a, b)


def fuzzy_score(a: Column, b: Column) -> Column:
    return F.round(fuzzy_raw(a, b), 4)


# -- what sets works apart
def season(title: Column) -> Column:
    """Number of a season or part as text, null for none."""
    t = F.lower(title)
    first, second = (F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in SEASON)
    raw = F.coalesce(first, second)
    numbers = F.create_map(*(F.lit(x) for pair in ROMAN.items() for x in pair))
    return F.coalesce(numbers[raw], raw)


def guards(title: Column, kind: Column | None = None) -> Column:
    """What a title says it is, apart from its name: novel, image pack, adult parody, season, side story."""
    t = F.coalesce(title, F.lit(""))
    of_kind = t if kind is None else F.concat_ws(" ", t, kind)
    return F.struct(of_kind.rlike(NOVEL).alias("novel"), t.rlike(PACK).alias("pack"), t.rlike(ADULT).alias("adult"), season(t).alias("season"), t.rlike(SPIN_OFF).alias("side"))


def synonyms(norm: Column) -> Column:
    """Normalised titles of the same work in other languages, for a normalised title."""
    squeeze = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    none = F.array().cast("array<string>")
    out = none
    for group in reversed(SYNONYMS):
        plain = [" ".join(w for w in re.sub(r"[^\w\s]", " ", n).split() if w not in NOISE) for n in group]
        names = F.array(*map(F.lit, plain))
        tight = F.array(*(F.lit(n.replace(" ", "")) for n in plain))
        out = F.when(F.array_contains(tight, squeeze(norm)), F.filter(names, lambda n: squeeze(n) != squeeze(norm))).otherwise(out)
    return out


def edition_conflict(a: Column, b: Column, na: Column, nb: Column, others: Column) -> Column:
    """Whether one of two titles names a part, adaptation, sequel or edition that the other doesn't.

    na, nb: normalised; others: synonyms of na, which b may be whatever it names.
    """
    x, y = F.array_distinct(_words(na)), F.array_distinct(_words(nb))
    shared = F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y))
    phrase = reduce(lambda p, q: p | q, (F.contains(na, F.lit(w)) != F.contains(nb, F.lit(w)) for w in PHRASES))
    odd = F.concat(F.array_except(x, y), F.array_except(y, x))
    marked = phrase | F.arrays_overlap(odd, F.array(*map(F.lit, MARKERS)))
    differs = (a.rlike(PART_ONE) != b.rlike(PART_ONE)) | (a.rlike(ADAPTED) != b.rlike(ADAPTED))
    by_words = ~F.array_contains(others, nb) & (F.coalesce(shared, F.lit(0.0)) >= 0.5) & marked
    return (na != "") & (nb != "") & (na != nb) & (differs | by_words)


def _step(df: DataFrame) -> DataFrame:
    """df behind a generator, so that its columns are made once and not in each of their uses."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def _cascade(pairs: DataFrame) -> DataFrame:
    """Adds method and confidence to rows of a, b, alias lists x, y, slugs sa, sb and kinds ka, kb."""
    squeeze = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    c = F.col
    rows = _step(pairs.withColumns({"na": normalize_title(c("a")), "nb": normalize_title(c("b")), "x": F.filter(F.transform("x", normalize_title), lambda n: n != ""), "y": F.filter(F.transform("y", normalize_title), lambda n: n != "")}))
    rows = _step(rows.withColumns({"ga": guards(c("a"), c("ka")), "gb": guards(c("b"), c("kb")), "ia": significant_key(c("na")), "ib": significant_key(c("nb")), "syn": synonyms(c("na"))}))
    about = lambda n: F.struct(n.alias("n"), squeeze(n).alias("s"), significant_key(n).alias("k"), (~n.rlike(GENERIC) & (F.contains(n, F.lit(" ")) | (F.length(n) >= 8))).alias("sound"))
    rows = _step(rows.withColumns({"xs": F.transform("x", about), "ys": F.transform("y", about), "overlap": token_overlap(c("na"), c("nb")), "score": fuzzy_score(c("na"), c("nb")), "conflict": edition_conflict(c("a"), c("b"), c("na"), c("nb"), c("syn"))}))
    one = F.coalesce(F.col("ga.season"), F.lit("1")) == F.coalesce(F.col("gb.season"), F.lit("1"))
    same = reduce(lambda p, q: p & q, (F.col(f"ga.{k}") == F.col(f"gb.{k}") for k in ("novel", "pack", "adult", "side")))
    apart = ~same | ~one | c("conflict")
    long_enough = (F.length("na") >= 3) & (F.length("nb") >= 3)
    slug_a, slug_b = (slugify(F.coalesce(F.nullif(c(s), F.lit("")), c(t))) for s, t in (("sa", "a"), ("sb", "b")))
    synonym = F.exists("syn", lambda s: squeeze(s) == squeeze(c("nb"))) | F.arrays_overlap("syn", "y")

    def longer(short, long, names):
        """The longer title is the shorter one and one of the shorter's other names."""
        rest = F.trim(F.regexp_replace(F.substring(long, F.length(short) + 1, F.length(long)), r"^[\s:–—\-]+", ""))
        return F.startswith(long, short) & (F.length(short) >= 10) & (F.length(rest) >= 6) & F.exists(names, lambda n: (F.length(n) >= 6) & (F.contains(rest, n) | F.contains(n, rest)))

    def named(names, norm, key, own):
        """One of a title's other names is the other title; short or generic ones only if they are the title itself."""
        equal = lambda n: (n["n"] == norm) | (n["s"] == squeeze(norm)) | F.coalesce(n["k"] == key, F.lit(False))
        return F.exists(names, lambda n: equal(n) & (n["sound"] | (n["n"] == own)))

    shared = F.exists(F.array_intersect("x", "y"), lambda n: (F.length(n) >= 8) & (F.contains(n, F.lit(" ")) | (F.length(n) >= 12)) & ~n.rlike(GENERIC_SHARED))
    inside = (F.contains(c("na"), c("nb")) & (F.size(_words(c("nb"))) >= 2)) | (F.contains(c("nb"), c("na")) & (F.size(_words(c("na"))) >= 2))
    close = long_enough & ((c("score") >= 0.85) | (inside & (c("overlap") >= 0.75)))
    rules = (
        (apart, "NO_MATCH", 0.0), ((c("na") != "") & (c("na") == c("nb")), "EXACT_TITLE", 1.0), (long_enough & (squeeze(c("na")) == squeeze(c("nb"))), "EXACT_TITLE", 0.98),
        (c("ia") == c("ib"), "EXACT_TITLE", 0.96), ((slug_a != "") & (slug_a == slug_b), "EXACT_SLUG", 1.0), (synonym, "ALIAS_EXACT", 0.96),
        (longer(c("na"), c("nb"), c("x")) | longer(c("nb"), c("na"), c("y")), "ALIAS_EXACT", 0.96),
        (named(c("xs"), c("nb"), c("ib"), c("na")) | shared | named(c("ys"), c("na"), c("ia"), c("nb")), "ALIAS_EXACT", 0.95), (close, "FUZZY_HIGH", None),
    )
    fuzzy = F.when(inside, F.greatest(c("score"), F.lit(0.88))).otherwise(c("score"))
    found = F.lit(None)
    for rule, method, confidence in reversed(rules):
        found = F.when(F.coalesce(rule, F.lit(False)), F.struct(F.lit(method).alias("method"), (fuzzy if confidence is None else F.lit(confidence)).alias("confidence"))).otherwise(found)
    none = F.struct(F.lit("NO_MATCH").alias("method"), F.lit(0.0).alias("confidence"))
    return rows.withColumn("found", F.coalesce(found, none)).select(*pairs.columns, "found.method", "found.confidence")


def match_titles(pairs: DataFrame, by: str, a: str, b: str, a_names: str | None = None, b_names: str | None = None, a_slug: str | None = None, b_slug: str | None = None, a_kind: str | None = None, b_kind: str | None = None) -> DataFrame:
    """(by, method, confidence): how the titles a and b of each row match, b being the candidate.

    What sets works apart comes first; then the rules from exact titles to fuzzy ones; then, for a candidate of several
    clauses (split at | // or / in spaces, brackets closed), its clauses by the same rules at 0.85 or more. Null titles
    count as empty and match nothing. Values of `by` must be distinct.
    """
    col = lambda n, kind="string": F.lit(None).cast(kind) if n is None else F.col(n)
    names = lambda n: F.coalesce(col(n, "array<string>"), F.array().cast("array<string>"))
    empty = lambda n: F.coalesce(F.col(n), F.lit(""))
    rows = pairs.select(F.col(by).alias("id"), empty(a).alias("a"), empty(b).alias("b"), names(a_names).alias("x"), names(b_names).alias("y"), col(a_slug).alias("sa"), col(b_slug).alias("sb"), col(a_kind).alias("ka"), col(b_kind).alias("kb"))
    closed = lambda p: F.regexp_count(p, F.lit(r"\(")) == F.regexp_count(p, F.lit(r"\)"))
    clauses = F.filter(F.transform(F.split("b", r"\s*(?:\||//|\s/\s)\s*"), F.trim), lambda p: p != "")
    parts = F.when(F.col("b").rlike(r"\||//|\s/\s") & (F.size(clauses) > 1), F.filter(clauses, lambda p: closed(p) & (p != F.col("b")))).otherwise(F.array().cast("array<string>"))
    each = rows.select("id", F.posexplode(F.concat(F.array("b"), parts)).alias("i", "b"), *(k for k in rows.columns if k not in ("id", "b")))
    done = _cascade(each).where("i = 0 or (method <> 'NO_MATCH' and confidence >= 0.85)")
    best = done.groupBy("id").agg(F.min(F.struct((F.col("method") == "NO_MATCH").alias("none"), "i", "method", "confidence")).alias("m"))
    return best.select(F.col("id").alias(by), "m.method", "m.confidence")


def metadata_evidence(pairs: DataFrame, by: str) -> DataFrame:
    """(by, score, automatic, ambiguous) of rows with a_ and b_ title, author, artist, kind, year and synopsis.

    Same author 0.3 (else same artist 0.2), kinds that agree or are unknown 0.1, years at most one apart or unknown
    0.05, a quarter of the best title similarity, 0.3 of the words that synopses share. Automatic: a creator, synopses
    of 0.72 and titles of 0.55; what sets works apart rules both out.
    """
    c = F.col
    rows = _step(pairs.withColumns({f"{s}_n": normalize_title(c(f"{s}_title")) for s in "ab"} | {f"{s}_g": guards(c(f"{s}_title"), c(f"{s}_kind")) for s in "ab"}))
    same = lambda k: (F.length(normalize_title(c(f"a_{k}"))) >= 3) & (normalize_title(c(f"a_{k}")) == normalize_title(c(f"b_{k}")))
    words = lambda s: F.array_join(F.filter(_words(normalize_title(c(f"{s}_synopsis"))), lambda w: F.length(w) >= 4), " ")
    rows = _step(rows.withColumns({"author": F.coalesce(same("author"), F.lit(False)), "artist": F.coalesce(same("artist"), F.lit(False)), "sa": words("a"), "sb": words("b"), "syn": synonyms(c("a_n"))}))
    known = lambda k: F.coalesce((c(f"a_{k}") != "") & (c(f"a_{k}") != "UNKNOWN") & (c(f"b_{k}") != "") & (c(f"b_{k}") != "UNKNOWN"), F.lit(False))
    rows = _step(rows.withColumns({
        "kind": ~known("kind") | (c("a_kind") == c("b_kind")), "near": F.coalesce((c("a_year") == 0) | (c("b_year") == 0) | (F.abs(c("a_year") - c("b_year")) <= 1), F.lit(True)),
        "title": F.greatest(dice_bigram(c("a_n"), c("b_n")), levenshtein_ratio(c("a_n"), c("b_n")), token_overlap(c("a_n"), c("b_n"))),
        "synopsis": F.when((F.length("sa") >= 30) & (F.length("sb") >= 30), token_overlap(c("sa"), c("sb"))).otherwise(0.0),
    }))
    apart = reduce(lambda p, q: p | q, (~F.col(f"a_g.{k}").eqNullSafe(F.col(f"b_g.{k}")) for k in ("novel", "season", "side"))) | edition_conflict(c("a_title"), c("b_title"), c("a_n"), c("b_n"), c("syn"))
    creator = F.when(c("author"), 0.3).when(c("artist"), 0.2).otherwise(0.0)
    score = F.round(F.least(F.lit(1.0), creator + F.when(c("kind"), 0.1).otherwise(0.0) + F.when(c("near"), 0.05).otherwise(0.0) + c("title") * 0.25 + c("synopsis") * 0.3), 4)
    sound = ~apart & (c("author") | c("artist")) & c("kind")
    automatic = sound & (c("synopsis") >= 0.72) & (c("title") >= 0.55)
    ambiguous = sound & ~automatic & (((c("synopsis") >= 0.35) & (c("title") >= 0.3)) | (c("title") >= 0.72))
    return rows.select(by, score.alias("score"), automatic.alias("automatic"), ambiguous.alias("ambiguous"))
